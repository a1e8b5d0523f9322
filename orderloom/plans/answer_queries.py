"""Queries over answers, contexts, records and the graph's remaining joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import answers
from orderloom.functions import text as tx
from orderloom.operators import catalog, retrieval
from orderloom.plans.base import RETRIEVAL_SQL, UTTERANCES_SQL, Tables, as_text, asked, nodes, query, quoted, rounded, sql_any, utterances
from orderloom.plans.dialogue_queries import ROUTER_SQL, menu, resolved, routed

VND = "replace(format('{{:,}}', {0}::BIGINT), ',', '.') || 'đ'"


def offers(t: Tables) -> DataFrame:
    """name and its variants, an array of size and price."""
    m = t.part.where("p_partkey % 3 <> 1 or p_size > 25").select(F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, ["S", "M", "L"])), (F.col("p_partkey") % 3 + 1).cast("int")).alias("size"), (F.col("p_size") * 1000).alias("price"))
    least = m.groupBy("name", "size").agg(F.min("price").alias("price"))
    v = F.array_sort(F.collect_list(F.struct(catalog.size_rank(F.col("size")).alias("rank"), "size", "price")))
    return least.groupBy("name").agg(F.transform(v, lambda x: F.struct(x["size"].alias("size"), x["price"].alias("price"))).alias("variants"))


OFFERS_SQL = """least AS (SELECT p_name AS name, ['S', 'M', 'L'][p_partkey % 3 + 1] AS size, p_partkey % 3 AS r, min(p_size * 1000) AS price FROM part WHERE p_partkey % 3 <> 1 OR p_size > 25 GROUP BY ALL)"""


@query(f"""WITH {OFFERS_SQL} SELECT name, CASE WHEN count(*) = 1 THEN any_value({VND.format("price")}) ELSE string_agg(size || ' ' || {VND.format("price")}, ' · ' ORDER BY r) END AS sizes,
  CASE WHEN min(price) = max(price) THEN {VND.format("min(price)")} ELSE replace({VND.format("min(price)")}, 'đ', '') || '–' || {VND.format("max(price)")} END AS span FROM least GROUP BY name""")
def size_lists(t: Tables) -> DataFrame:
    return offers(t).select("name", answers.size_list(F.col("variants")).alias("sizes"), answers.price_range(F.col("variants")).alias("span"))


@query(f"""SELECT p_partkey, p_name || ' size M (' || {VND.format("p_size * 1000")} || ')' || CASE WHEN p_partkey % 2 = 0 THEN ' is fine' ELSE ' — Fine' END AS description FROM part""")
def variant_descriptions(t: Tables) -> DataFrame:
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" is fine"))).otherwise("Fine")
    return t.part.select("p_partkey", answers.variant_description(F.col("p_name"), F.lit("M"), F.col("p_size") * 1000, text).alias("description"))


@query(f"""WITH {RETRIEVAL_SQL}, f AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS i, text FROM ranked WHERE place <= 5)
SELECT query_id, md5('FAQ_CONTEXT:' || chr(10) || string_agg(i || '. ' || text, chr(10) ORDER BY i) || chr(10) || chr(10) || 'FAQ_RULES:' || chr(10) || {' || chr(10) || '.join(map(quoted, answers.FAQ_RULES))}) AS context FROM f GROUP BY query_id""")
def faq_contexts(t: Tables) -> DataFrame:
    hits = retrieval.retrieve_by_keyword(asked(t), nodes(t))
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "source_id", "text"))), lambda r: r["text"])
    return hits.groupBy("query_id").agg(rows.alias("texts")).select("query_id", F.md5(answers.faq_context(F.col("texts"))).alias("context"))


@query(f"""WITH {OFFERS_SQL}, s AS (SELECT name, CASE WHEN count(*) = 1 THEN any_value({VND.format("price")}) ELSE string_agg(size || ' ' || {VND.format("price")}, ' · ' ORDER BY r) END AS sizes FROM least GROUP BY name)
SELECT name, md5('RECOMMENDABLE_MENU_ITEMS:' || chr(10) || '- item: ' || name || ' | sizes: ' || sizes || ' | category: tea | note: good' || chr(10) || chr(10) || 'SUPPORTING_CONTEXT:' || chr(10) || '- policy' || chr(10) || chr(10)
  || 'CONSULTANT_RULES:' || chr(10) || {' || chr(10) || '.join(map(quoted, answers.CONSULTANT_RULES))}) AS context FROM s""")
def consultant_contexts(t: Tables) -> DataFrame:
    item = F.array(F.struct("name", "variants", F.lit("tea").alias("category"), F.lit("good").alias("note")))
    return offers(t).select("name", F.md5(answers.consultant_context(item, F.array(F.lit("policy")))).alias("context"))


@query(f"""WITH {UTTERANCES_SQL}, m AS (SELECT p_name, floor(min(p_retailprice))::INT AS p FROM part GROUP BY p_name)
SELECT utter_id AS query_id, 'Dạ, em ghi nhận **' || quantity || ' ' || item || ' size ' || size || '** — ' || {VND.format("(p + CASE size WHEN 'S' THEN 0 WHEN 'M' THEN 5000 ELSE 10000 END)")} || '/ly. Anh/chị xác nhận giúp em nhé? 😊' AS answer
FROM utterances JOIN m ON p_name = item WHERE kind IN (0, 6)""")
def order_answers(t: Tables) -> DataFrame:
    r = resolved(t).where("kind in (0, 6)")
    v = menu(t).groupBy(F.col("name").alias("item")).agg(F.array_sort(F.collect_list(F.struct("size", "price"))).alias("variants"))
    c = F.col
    answer = answers.order_answer(c("action"), c("item"), c("size"), c("quantity"), c("price"), c("variants"), c("unknown_words"))
    return r.join(v, "item").select("query_id", answer.alias("answer"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Dạ, với tiêu chí giá mềm và dễ uống, ' || lower(a[1]) || a[2:] WHEN 1 THEN 'Dạ, với tiêu chí giá mềm, ' || lower(a[1]) || a[2:]
  WHEN 2 THEN 'Dạ, em gợi ý như sau: ' || lower(a[1]) || a[2:] ELSE a END AS answer FROM (SELECT event_id, 'Món ' || event_type AS a FROM events)""")
def cached_answers(t: Tables) -> DataFrame:
    m = F.col("event_id") % 5
    context = F.when(m == 0, "giá mềm, dễ uống").when(m == 1, "rẻ").otherwise("")
    intent = F.when(m == 3, "faq").otherwise("consultant")
    answer = F.concat(F.lit("Món "), "event_type")
    return t.events.select("event_id", answers.cached_answer(answer, intent, context, F.when(m == 2, "gợi ý món").otherwise("")).alias("answer"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'order' WHEN event_type = 'error' THEN NULL ELSE 'faq' END AS label, event_type AS guess FROM events")
def model_labels(t: Tables) -> DataFrame:
    said = F.when(F.col("event_type").isin("click", "view"), " It is ORDER, not faq. ").when(F.col("event_type") == "error", "?").otherwise("FAQ")
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.upper("event_type").alias("action")))).otherwise(F.concat(F.lit(" "), F.upper("event_type")))
    return t.events.select("event_id", answers.label_in(said).alias("label"), answers.prediction(raw).alias("guess"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'm' ELSE 'Dạ, em chưa hiểu câu hỏi của anh/chị. Anh/chị thử hỏi lại nhé ạ 😊' END AS answer,
  CASE WHEN event_id % 3 = 0 THEN 'exact' WHEN event_id % 3 = 1 THEN 'semantic' ELSE '' END AS cache FROM events""")
def response_parsing(t: Tables) -> DataFrame:
    m = F.col("event_id") % 3
    body = (
        F.when(m == 0, F.concat(F.lit('{"answer": " '), "event_type", F.lit(' ", "metadata": {"cache": {"hit": true, "exact": {"hit": true}}}}')))
        .when(m == 1, '{"answer": " ", "message": "m", "metadata": {"cache": {"hit": true, "semantic": {"hit": true}}}}')
        .otherwise('{"content": "", "metadata": {"cache": {"hit": false}}}')
    )
    return t.events.select("event_id", answers.response_answer(body).alias("answer"), answers.cache_kind(body).alias("cache"))


@query(r"""SELECT conv_id, turn, pace, count(*) AS n FROM (SELECT conv_id, turn, CASE WHEN i = 1 THEN 'first_word' WHEN regexp_matches(w, '[.!?:—]$') THEN 'punctuation' WHEN regexp_matches(w, '^[•*-]') THEN 'bullet'
  WHEN length(w) > 8 THEN 'long_word' ELSE 'word' END AS pace FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM conversations))) GROUP BY ALL""")
def typing_paces(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", F.posexplode(tx.tokens(F.col("text"))).alias("i", "w"))
    return w.select("conv_id", "turn", answers.typing_pace(F.col("w"), F.col("i") == 0).alias("pace")).groupBy("conv_id", "turn", "pace").agg(F.count("*").alias("n"))


@query(f"""WITH {ROUTER_SQL} SELECT utter_id, '{{"messages":[{{"role":"system","content":"Label it."}},{{"role":"user","content":"' || text || '"}},{{"role":"assistant","content":"' || intent || '"}}]}}' AS record FROM routed""")
def sft_records(t: Tables) -> DataFrame:
    return routed(t).select("utter_id", answers.chat_record("Label it.", F.col("text"), F.col("intent")).alias("record"))


def _coin(salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || utter_id), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _typos() -> str:
    out = "text"
    for i, (word, wrong) in enumerate(answers.TYPOS):
        out = f"CASE WHEN {_coin('t')} <= 0.5 AND length(text) >= 6 AND {_coin(f't{i}')} < 0.5 THEN replace({out}, '{word}', '{wrong}') ELSE {out} END"
    return out


@query(f"""WITH {UTTERANCES_SQL} SELECT utter_id, CASE WHEN {_coin('p')} <= 0.5 THEN o || ' ' || {answers.POLITE['vi']}[floor({_coin('e')} * 5)::INT + 1] ELSE o END AS text
FROM (SELECT utter_id, {_typos()} AS o FROM utterances)""")
def noisy_texts(t: Tables) -> DataFrame:
    return utterances(t).select("utter_id", answers.noisy(F.col("text"), F.col("utter_id"), F.lit("vi"), 0.5, 0.5).alias("text"))


@query("""SELECT p.p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND contains(lower(s_name), '#000000007'))""")
def edge_semi_join(t: Tables) -> DataFrame:
    """Nodes with an edge to an entity whose name holds a term."""
    entities = t.supplier.where(F.lower("s_name").contains("#000000007")).select("s_suppkey")
    edges = t.lineitem.select("l_partkey", "l_suppkey").join(entities, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return t.part.select("p_partkey").join(edges, F.col("p_partkey") == F.col("l_partkey"), "left_semi")


@query("""SELECT c_custkey, coalesce(string_agg(o_orderpriority, ',' ORDER BY r, o_orderpriority), '') AS options FROM customer LEFT JOIN (
  SELECT DISTINCT o_custkey, o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 0 WHEN '1' THEN 1 ELSE 99 END AS r FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey""")
def nested_options(t: Tables) -> DataFrame:
    """N:M assembly with a custom order of the nested rows; unknown codes come last."""
    code = F.substring("o_orderpriority", 1, 1)
    o = t.orders.select("o_custkey", "o_orderpriority").distinct().withColumn("r", F.when(code == "3", 0).when(code == "1", 1).otherwise(99))
    nested = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "o_orderpriority"))), lambda s: s["o_orderpriority"]).alias("options"))
    return t.customer.join(nested, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(as_text(F.col("options")), F.lit("")).alias("options"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, entry, round(s, 6) AS similarity, round(s, 6) >= 0.6 AS hit FROM (
  SELECT q.vec_id, x.vec_id AS entry, list_inner_product(q.e, x.e) / (q.n * x.n) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, x.e) / (q.n * x.n), 9) DESC, x.vec_id) AS r
  FROM v q JOIN v x ON q.label = x.label AND q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id) WHERE r = 1""")
def nearest_cached(t: Tables) -> DataFrame:
    """Each query's nearest other entry of the same intent (here label), and whether it answers."""
    e = t.embeddings.select("vec_id", "label", "embedding")
    best = retrieval.nearest_of_label(e.where("vec_id % 20 = 0"), e, "vec_id", "label")
    return rounded(best.select("vec_id", "entry", "similarity"), "similarity").withColumn("hit", F.col("similarity") >= 0.6)


@query("SELECT 'part' AS node, count(*) - count(DISTINCT p_partkey) AS violations FROM part UNION ALL SELECT 'name', count(*) - count(DISTINCT p_name) FROM part")
def uniqueness(t: Tables) -> DataFrame:
    def extra(key: str, name: str) -> DataFrame:
        n = t.part.groupBy(key).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("node"), "violations")

    return extra("p_partkey", "part").unionByName(extra("p_name", "name"))


@query("""SELECT o_custkey AS source_id, l_suppkey AS target_id, round(0.8::DOUBLE * 0.75::DOUBLE * 0.85::DOUBLE, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 20 = 0 AND o_custkey <> l_suppkey))
WHERE r <= 10""")
def mention_expansion(t: Tables) -> DataFrame:
    """Entities that the hits mention, ten at most for each."""
    edges = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("source_id"), F.lit("MENTIONS").alias("relation"), F.col("l_suppkey").alias("target_id"))
    hits = t.customer.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), F.lit("faq").alias("intent"), F.col("c_custkey").alias("source_id"), F.lit(0.8).alias("score"))
    entities = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.lit("entity").alias("source_type"), retrieval.entity_passage(F.col("s_name"), F.lit("supplier")).alias("text"))
    found = retrieval.expand(hits, edges, entities, "MENTIONS", lx.ENTITY_FACTOR, lx.ENTITY_LIMIT)
    return rounded(found.select(F.col("query_id").alias("source_id"), F.col("source_id").alias("target_id"), "score"), "score")


@query(f"SELECT conv_id, turn, CASE WHEN {sql_any('lower(text)', ['hello', 'hi'])} THEN 1 ELSE 0 END AS greets FROM conversations WHERE role = 'user'")
def message_scan(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", tx.any_of(F.lower("text"), ["hello", "hi"]).cast("int").alias("greets"))


_TEXT = lambda value: quoted(value).replace("\n", "' || chr(10) || '")


@query(f"""WITH {OFFERS_SQL}, s AS (SELECT name, CASE WHEN count(*) = 1 THEN any_value({VND.format("price")}) ELSE string_agg(size || ' ' || {VND.format("price")}, ' · ' ORDER BY r) END AS sizes FROM least GROUP BY name)
SELECT p_partkey AS id, md5(CASE p_partkey % 7 WHEN 0 THEN {_TEXT(answers.SMALL_TALK)} WHEN 1 THEN {_TEXT(answers.NO_FACT)} WHEN 2 THEN {_TEXT(answers.FACT_HEAD)} || p_name || {_TEXT(answers.FACT_END)}
  WHEN 3 THEN {_TEXT(answers.NO_ADVICE)} WHEN 4 THEN {_TEXT(answers.FOUND_HEAD)} || p_name || {_TEXT(answers.FOUND_END)} WHEN 5 THEN 'taken'
  ELSE {_TEXT(answers.ADVICE_HEAD)} || coalesce('• **' || p_name || '** — ' || lower(p_type) || chr(10) || '   ' || sizes, '') || {_TEXT(answers.ADVICE_END)} END) AS answer
FROM part LEFT JOIN s ON name = p_name""")
def fallback_answers(t: Tables) -> DataFrame:
    """Each agent's answer without a model: with and without context, with and without items."""
    k = F.col("id") % 7
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("note")).join(offers(t), "name", "left")
    variants = F.coalesce("variants", F.filter(F.array(F.struct(F.lit("S").alias("size"), F.lit(0).alias("price"))), lambda v: F.lit(False)))
    item = F.array(F.struct("name", variants.alias("variants"), F.concat("name", F.lit(" — "), "note").alias("description")))
    intent = F.when(k == 0, "ignore").when(k <= 2, "faq").when(k == 5, "order").otherwise("consultant")
    items = F.when(k == 6, item)
    answer = answers.fallback_answer(intent, F.lit("taken"), items, F.when(k >= 4, F.col("name")), F.when(k == 2, F.col("name")))
    return p.select("id", F.md5(answer).alias("answer"))


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_partkey, floor(l_extendedprice)::BIGINT AS price, CASE WHEN l_linenumber % 3 <> 0 THEN ['S', 'M', 'L'][l_linenumber % 3] END AS size FROM lineitem),
s AS (SELECT l_orderkey, string_agg('• ' || q || ' món ' || l_partkey || coalesce(' size ' || size, '') || ' — ' || {VND.format("(price * q)")}, chr(10) ORDER BY l_linenumber, q, l_partkey::VARCHAR, price) AS body, {VND.format("sum(price * q)::BIGINT")} AS total FROM l GROUP BY l_orderkey)
SELECT l_orderkey, md5({_TEXT(answers.CHECKOUT_HEAD)} || body || chr(10) || '**{answers.TOTAL}: ' || total || '**' || {_TEXT(answers.CHECKOUT_END)}) AS checkout,
  md5('Dạ.' || {_TEXT(answers.CART_HEAD)} || body || chr(10) || '**{answers.SUBTOTAL}: ' || total || '**' || {_TEXT(answers.CART_END)}) AS updated FROM s""")
def cart_summaries(t: Tables) -> DataFrame:
    """Carts as they are read back before checkout, and after a change."""
    size = F.when(F.col("l_linenumber") % 3 != 0, F.element_at(F.array(*map(F.lit, ["S", "M"])), F.greatest(F.col("l_linenumber") % 3, F.lit(1)).cast("int")))
    line = F.struct(
        F.col("l_linenumber").alias("place"), F.col("l_quantity").cast("long").alias("quantity"), F.concat(F.lit("món "), F.col("l_partkey").cast("string")).alias("item"),
        size.alias("size"), F.floor("l_extendedprice").alias("price"),
    )
    carts = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return carts.select("l_orderkey", F.md5(answers.checkout_answer(F.col("lines"))).alias("checkout"), F.md5(answers.cart_updated(F.lit("Dạ."), F.col("lines"))).alias("updated"))


@query("SELECT conv_id, turn, role, md5(text) AS text FROM conversations ORDER BY conv_id, turn")
def messages_in_order(t: Tables) -> DataFrame:
    """All messages in order of their keys, as a log is read back: a range sort, no single task."""
    return t.conversations.orderBy("conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("text"))
