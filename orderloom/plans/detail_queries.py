"""Smaller projections: names, subjects, footers, contexts, messages, labels, samples, and the catalog from seed to graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import answers
from orderloom.functions import text as tx
from orderloom.operators import catalog, metrics, retrieval
from orderloom.plans.base import MENU_SQL, RETRIEVAL_SQL, UTTERANCES_SQL, Tables, as_text, asked, menu_rows, nodes, query, sql_any, utterances
from orderloom.plans.dialogue_queries import menu, resolved

# Word boundaries of the oracle's engine know ASCII letters only, so its patterns spell them out.
WHO = "anh|chị|em|mình|tôi|tui|bọn em|tụi em"
EDGE = r"(^|[^\p{L}\p{N}_])"


@query(f"""WITH {RETRIEVAL_SQL}, m AS (SELECT query_id, trim(split_part(text, '|', 1)) AS item, min(place) AS place FROM ranked WHERE source_type = 'menu' AND place <= 5 GROUP BY ALL)
SELECT query_id, string_agg(item, ';' ORDER BY place) AS items FROM m GROUP BY query_id""")
def menu_item_names(t: Tables) -> DataFrame:
    """Distinct items among the menu sources, in the order of rank."""
    hits = retrieval.retrieve_by_keyword(asked(t), nodes(t)).where("source_type = 'menu'")
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "source_id", tx.item_name(F.col("text")).alias("item"))))
    names = hits.groupBy("query_id").agg(F.array_distinct(F.transform(ranked, lambda h: h["item"])).alias("items"))
    return names.select("query_id", F.array_join(F.filter("items", lambda i: i != ""), ";").alias("items"))


@query(f"""WITH {MENU_SQL} SELECT id, name || ' | ' || name || ' | ' || category || ' | ' || description || ' | ' || price || ' VND | Size ' || size AS menu,
  'Topic: ' || category || chr(10) || 'Question: ' || name || chr(10) || 'Answer: ' || description AS faq FROM menu""")
def embedding_inputs(t: Tables) -> DataFrame:
    m = menu_rows(t).withColumn("description", F.regexp_replace("description", catalog.SIZE_CLAUSE, ""))
    c = F.col
    return m.select("id", answers.menu_embedding_input(c("name"), c("name"), c("category"), c("description"), c("price"), c("size")).alias("menu"), answers.faq_embedding_input(c("category"), c("name"), c("description")).alias("faq"))


@query(f"""WITH {UTTERANCES_SQL} SELECT utter_id, CASE WHEN {sql_any("lower(text)", lx.ANY_VI_MARKERS)} THEN 'vi' ELSE 'en' END AS any_marker,
  CASE WHEN regexp_matches(lower(text), '{lx.VI_DIACRITICS}') THEN 'vi' WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(hello|hi|order|coffee|tea|recommend|what|which|where)($|[^\\p{{L}}\\p{{N}}_])') THEN 'en' ELSE 'unknown' END AS by_word FROM utterances""")
def language_variants(t: Tables) -> DataFrame:
    return utterances(t).select("utter_id", tx.any_marker_language(F.col("text")).alias("any_marker"), tx.generated_language(F.col("text")).alias("by_word"))


@query(f"""WITH {UTTERANCES_SQL}, x AS (SELECT utter_id, lower(text) AS l, text FROM utterances)
SELECT utter_id, coalesce(nullif(regexp_extract(l, '{EDGE}cho\\s+({WHO})($|[^\\p{{L}}\\p{{N}}_])', 2), ''), nullif(regexp_extract(l, '{EDGE}({WHO})\\s+(muốn|cần|hỏi|xin|đặt|gọi|lấy|order|thích)($|[^\\p{{L}}\\p{{N}}_])', 2), ''), '') AS vi,
  CASE WHEN regexp_matches(text, '(?i){EDGE}we($|[^\\p{{L}}\\p{{N}}_])') THEN 'we' WHEN regexp_matches(text, '(?i){EDGE}i($|[^\\p{{L}}\\p{{N}}_])') THEN 'I' ELSE '' END AS en FROM x""")
def dataset_subjects(t: Tables) -> DataFrame:
    with_suffix = F.concat("text", F.lit(" #"), F.col("utter_id").cast("string"))
    return utterances(t).select("utter_id", tx.subject_vi(with_suffix).alias("vi"), tx.subject_en(F.col("text")).alias("en"))


@query("""SELECT event_id, chr(10) || chr(10) || '---' || chr(10) || CASE event_type WHEN 'click' THEN '🛒 **Đặt hàng**' WHEN 'view' THEN '❓ **Hỏi đáp**' ELSE '🤖 **' || event_type || '**' END
  || CASE event_id % 3 WHEN 0 THEN ' · ⚡ Exact hit' WHEN 1 THEN ' · ⚡ Cache hit' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '  ·  ↪ *and tea?*' ELSE '' END
  || '  ·  `' || round_even(value, 0)::BIGINT || ' ms`  ·  `s' || user_id || '`' AS footer FROM events""")
def footers(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "order").when(F.col("event_type") == "view", "faq").otherwise(F.col("event_type"))
    tier = F.when(F.col("event_id") % 3 == 0, "exact").when(F.col("event_id") % 3 == 1, "")
    follow = F.when(F.col("event_id") % 5 == 0, "and tea?")
    return t.events.select("event_id", answers.footer(kind, F.col("value"), tier, follow, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("footer"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS label, CASE event_id % 4 WHEN 0 THEN event_type ELSE '' END AS action FROM events""")
def coerced_labels(t: Tables) -> DataFrame:
    """A model's label or the router's, and a text field of its extraction: here one in four is a text, the others a number, missing or broken."""
    e = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("action")))).when(F.col("event_id") % 4 == 1, '{"action": 5}').when(F.col("event_id") % 4 == 2, "{}").otherwise("{")
    return t.events.select("event_id", answers.coerced(F.col("event_type"), ["click", "view"], F.lit("other")).alias("label"), answers.extraction_value(e, "action").alias("action"))


@query("""SELECT conv_id, len(h)::INT + 2 AS n, md5('system:Be kind.' || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'TÓM TẮT HỘI THOẠI TRƯỚC ĐÓ:' || chr(10) || 'they met' ELSE '' END || '|' || array_to_string(h, '|') || CASE WHEN len(h) > 0 THEN '|' ELSE '' END
  || 'user:' || CASE WHEN conv_id % 3 = 0 THEN 'CONTEXT:' || chr(10) || 'facts' || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) ELSE '' END || 'why?') AS request FROM (
  SELECT conv_id, coalesce(list(role || ':' || text ORDER BY turn) FILTER (role IN ('user', 'assistant', 'system') AND trim(text) <> ''), []) AS h FROM conversations GROUP BY conv_id)""")
def model_requests(t: Tables) -> DataFrame:
    h = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    made = answers.model_request(F.lit("Be kind."), F.when(F.col("conv_id") % 2 == 0, "they met"), F.col("h"), F.when(F.col("conv_id") % 3 == 0, "facts"), F.lit("why?"))
    shown = F.array_join(F.transform("m", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return h.select("conv_id", made.alias("m")).select("conv_id", F.size("m").alias("n"), F.md5(shown).alias("request"))


@query()
def order_contexts(t: Tables) -> DataFrame:
    """What a model is told about each resolved order."""
    v = F.array_sort(F.collect_set(F.struct(catalog.size_rank(F.col("size")).alias("r"), "size", "price")))
    own = menu(t).groupBy(F.col("name").alias("item")).agg(v.alias("v"))
    own = own.select("item", F.transform("v", lambda x: F.struct(x["size"].alias("size"), x["price"].alias("price"))).alias("variants"))
    o = resolved(t)
    named = o.select("query_id", F.posexplode("choices").alias("at", "item")).join(own, "item").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("item").alias("name"), "variants"))).alias("offers"))
    c = F.col
    rows = o.join(own, "item", "left").join(named, "query_id", "left")
    description = F.concat(c("item"), F.lit(" — good, cold. More."))
    return rows.select("query_id", "action", answers.order_context(c("action"), c("item"), c("quantity"), c("size"), c("price"), c("variants"), c("offers"), description).alias("context"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND event_id % 2 = 0 THEN 'À, món **2 tea' || CASE WHEN event_id % 4 = 0 THEN ' size M' ELSE '' END || '** lúc nãy anh/chị xác nhận giúp em để em thêm vào đơn nhé?' END AS reminder FROM events""")
def pending_reminders(t: Tables) -> DataFrame:
    intent = F.when(F.col("event_type") == "click", "faq").when(F.col("event_type") == "view", "consultant").when(F.col("event_type") == "error", "ignore").otherwise("order")
    label = answers.line_label(F.lit(2), F.lit("tea"), F.when(F.col("event_id") % 4 == 0, "M"))
    return t.events.select("event_id", answers.pending_reminder(intent, F.when(F.col("event_id") % 2 == 0, "confirm_line").otherwise("order_question"), label).alias("reminder"))


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error' AND event_id > coalesce(d, -1)) AS messages, arg_max(event_type, event_id) FILTER (event_type <> 'error' AND event_id > coalesce(d, -1)) AS last
FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS d FROM events) GROUP BY user_id""")
def session_messages(t: Tables) -> DataFrame:
    """A session's messages since it was last deleted (here: event error), and the last one."""
    gone = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("d"))
    live = (F.col("event_type") != "error") & (F.col("event_id") > F.coalesce("d", F.lit(-1)))
    rows = t.events.select("user_id", "event_id", "event_type").join(gone, "user_id", "left")
    return rows.groupBy("user_id").agg(F.count_if(live).alias("messages"), F.max_by(F.when(live, F.col("event_type")), F.when(live, F.col("event_id"))).alias("last"))


@query("""WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM documents)
SELECT md5(text) AS sample, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM s GROUP BY text HAVING count(DISTINCT split) > 1""")
def split_duplicates(t: Tables) -> DataFrame:
    """Samples that more than one split holds."""
    part = lambda name, rows: t.documents.where(rows).select("text", F.lit(name).alias("split"))
    all_ = part("train", "doc_id % 10 < 8").unionByName(part("validation", "doc_id % 10 = 8")).unionByName(part("test", "doc_id % 10 = 9"))
    found = all_.groupBy("text").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count("*").alias("n")).where("size(splits) > 1")
    return found.select(F.md5("text").alias("sample"), as_text(F.col("splits")).alias("splits"), "n")


@query("""SELECT 'intent' AS rule, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS violations FROM events UNION ALL SELECT 'action', count(*) FILTER (event_id % 9 = 0 AND event_type IN ('click', 'view')) FROM events
UNION ALL SELECT 'cache_key', 0""")
def sample_validation(t: Tables) -> DataFrame:
    """Which rules dataset samples break; those of intent ignore need no action."""
    s = t.events.select("event_type", F.when(F.col("event_id") % 9 == 0, " ").otherwise("a").alias("action"), F.lit("k").alias("cache_key"))
    business = F.col("event_type").isin("click", "view")
    filled = lambda c: ~business | (tx.strip(F.col(c)) != "")
    return metrics.violations(s, {"intent": F.col("event_type").isin("click", "view", "purchase"), "action": filled("action"), "cache_key": filled("cache_key")})


@query(f"""WITH {MENU_SQL}, p AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, arg_min(category, ord) AS category FROM menu GROUP BY 1)
SELECT 'products' AS kind, count(*) AS n FROM p UNION ALL SELECT 'variants', count(*) FROM menu UNION ALL SELECT 'faqs', count(*) FROM benchmark UNION ALL SELECT 'chunks', count(*) FROM documents
UNION ALL SELECT 'option_links', sum(CASE category WHEN 'freeze' THEN 2 WHEN 'food' THEN 0 ELSE 2 END)::BIGINT FROM p""")
def seed_counts(t: Tables) -> DataFrame:
    """The catalog from its sources, counted: products, variants, option links, FAQ entries and policy chunks."""
    return catalog.seed_counts(catalog.products(menu_rows(t)), t.benchmark, t.documents)


@query("""WITH k AS (SELECT DISTINCT substr(unnest(string_split(p_name, ' ')), 1, 3) AS k FROM part), faq AS (SELECT 'faq_' || item_id AS id, text FROM benchmark), chunk AS (SELECT 'doc_' || lpad(doc_id::VARCHAR, 12, '0') AS id, text, lang FROM documents),
menu AS (SELECT 'menu_' || p_partkey AS id, ['coffee', 'tea', 'freeze', 'food'][p_size % 4 + 1] AS category, lower(p_type) AS tag, lower(p_name) AS n FROM part),
e AS (SELECT 'BELONGS_TO' AS relation, id AS s, category AS d FROM menu UNION ALL SELECT 'HAS_TAG', id, 'tag::' || tag FROM menu UNION ALL SELECT DISTINCT 'HAS_INGREDIENT', id, unnest(string_split(n, ' ')) FROM menu
  UNION ALL SELECT 'MENTIONS', id, 'topic::' || k FROM faq JOIN k ON contains(lower(text), k) UNION ALL SELECT * FROM (SELECT 'NEXT' AS relation, id AS s, lead(id) OVER (PARTITION BY lang ORDER BY id) AS d FROM chunk) WHERE d IS NOT NULL)
SELECT relation AS label, count(*) AS n, count(DISTINCT s) AS sources, count(DISTINCT d) AS targets FROM e GROUP BY relation
UNION ALL SELECT 'MenuItem', count(*), 0, 0 FROM menu UNION ALL SELECT 'FAQ', count(*), 0, 0 FROM faq UNION ALL SELECT 'DocumentChunk', count(*), 0, 0 FROM chunk""")
def graph_projection(t: Tables) -> DataFrame:
    """The graph that the catalog, the FAQ and the policy chunks make: edges by relation, and nodes by label."""
    m = menu_rows(t).select(F.col("id").alias("source_id"), "category", F.slice(catalog.listed(F.col("tags")), 1, 1).alias("tags"), catalog.listed(F.lower("ingredients")).alias("ingredients"))
    faq = t.benchmark.select(F.concat(F.lit("faq_"), F.col("item_id").cast("string")).alias("source_id"), "text")
    chunks = t.documents.select(F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("source_id"), F.col("lang").alias("document"), "text")
    k = t.part.select(F.explode(F.split("p_name", " ")).alias("k")).select(F.substring("k", 1, 3).alias("k")).distinct()
    topics = k.select(F.concat(F.lit("topic::"), "k").alias("entity_id"), F.array("k").alias("keywords"))
    edges = catalog.projection(m, faq, chunks, topics)
    counted = edges.groupBy(F.col("relation").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"))
    for label, df in (("MenuItem", m), ("FAQ", faq), ("DocumentChunk", chunks)):
        counted = counted.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n", F.lit(0).cast("long").alias("sources"), F.lit(0).cast("long").alias("targets")))
    return counted
