"""Evaluation, dataset and cart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx
from orderloom.operators import metrics
from orderloom.plans.base import TEMPLATES, UTTERANCES_SQL, Tables, query, utterances
from orderloom.plans.dialogue_queries import ROUTER_SQL, TRUTH, routed


def judged(t: Tables) -> DataFrame:
    truth = F.element_at(F.array(*map(F.lit, TRUTH)), F.col("kind") + 1)
    return routed(t).select("utter_id", truth.alias("truth"), F.col("intent").alias("guess"), F.when(F.col("kind") % 4 == 0, "hard").otherwise("easy").alias("difficulty"))


JUDGED_SQL = f"{ROUTER_SQL}, judged AS (SELECT utter_id, {TRUTH}[kind + 1] AS truth, intent AS guess, CASE WHEN kind % 4 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM routed)"


@query(f"""WITH {JUDGED_SQL}, l AS (SELECT unnest({lx.INTENTS}) AS label),
c AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (truth <> label AND guess = label) AS fp, count(*) FILTER (truth = label AND guess <> label) AS fn FROM l, judged GROUP BY label),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c)
SELECT label, tp, fp, fn, tp + fn AS support, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM p""")
def classification_metrics(t: Tables) -> DataFrame:
    return metrics.classification(judged(t), lx.INTENTS)


@query(f"""WITH {JUDGED_SQL} SELECT truth, {', '.join(f"count(*) FILTER (guess = '{i}') AS {i}" for i in lx.INTENTS)}, 0::BIGINT AS parse_error FROM judged GROUP BY truth""")
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion(judged(t), lx.INTENTS)


@query(f"WITH {JUDGED_SQL} SELECT difficulty, truth, round(avg((truth = guess)::INT), 4) AS accuracy, count(*) AS n FROM judged GROUP BY GROUPING SETS ((difficulty), (truth), ())")
def sliced_accuracy(t: Tables) -> DataFrame:
    right = (F.col("truth") == F.col("guess")).cast("int")
    return judged(t).groupingSets([["difficulty"], ["truth"], []], "difficulty", "truth").agg(F.round(F.avg(right), 4).alias("accuracy"), F.count("*").alias("n"))


@query(f"WITH {JUDGED_SQL} SELECT utter_id, truth, guess FROM judged WHERE truth <> guess ORDER BY utter_id LIMIT 50")
def error_sample(t: Tables) -> DataFrame:
    """The first fifty errors, as the report lists them."""
    return judged(t).where("truth <> guess").select("utter_id", "truth", "guess").orderBy("utter_id").limit(50)


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency_summary(t: Tables) -> DataFrame:
    return metrics.latency(t.events, "value", "event_type")


@query("SELECT event_type, value AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = round_even((n - 1) * 0.95, 0)")
def nearest_rank_p95(t: Tables) -> DataFrame:
    return metrics.nearest_rank(t.events, "value", 0.95, "event_type")


@query("""SELECT event_type, round(v[j] * (1 - g) + v[j + 1] * g, 6) AS quantile FROM (
  SELECT event_type, v, least(greatest(floor(0.9::DOUBLE * (len(v) + 1)), 1), len(v) - 1)::INT AS j, 0.9::DOUBLE * (len(v) + 1) - least(greatest(floor(0.9::DOUBLE * (len(v) + 1)), 1), len(v) - 1) AS g
  FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type))""")
def exclusive_p90(t: Tables) -> DataFrame:
    found = metrics.exclusive_quantile(t.events, "value", 0.9, "event_type")
    return found.select("event_type", F.round("quantile", 6).alias("quantile"))


@query("""SELECT count(*) AS requests, round(count(*) FILTER (h) / greatest(1, count(*)), 4) AS hit_rate, round(count(*) FILTER (h AND c) / greatest(1, count(*) FILTER (c)), 4) AS cacheable_hit_rate,
  round(count(*) FILTER (h AND i = 'order') / greatest(1, count(*) FILTER (i = 'order')), 4) AS false_hit_rate,
  round(count(*) FILTER (h AND c) / greatest(1, count(*) FILTER (c)), 4) >= 0.6 AND round(count(*) FILTER (h AND i = 'order') / greatest(1, count(*) FILTER (i = 'order')), 4) = 0 AS passed
FROM (SELECT ['faq', 'order', 'consultant', 'ignore'][event_id % 4 + 1] AS i, event_id % 4 <> 1 AS c, value > 10 AND event_id % 4 <> 1 AS h FROM events)""")
def cache_benchmark(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["faq", "order", "consultant", "ignore"])), (F.col("event_id") % 4 + 1).cast("int"))
    cacheable = F.col("event_id") % 4 != 1
    return metrics.cache_rollup(t.events.select(kind.alias("intent"), cacheable.alias("cacheable"), ((F.col("value") > 10) & cacheable).alias("hit")))


@query("SELECT l_orderkey, sum(l_quantity * floor(l_extendedprice))::BIGINT AS total, count(*) AS lines FROM lineitem GROUP BY l_orderkey")
def cart_totals(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * F.floor("l_extendedprice")).cast("long").alias("total"), F.count("*").alias("lines"))


@query("SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS quantity, min(l_orderkey) AS first FROM lineitem GROUP BY l_suppkey, l_partkey")
def cart_merge(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.min("l_orderkey").alias("first"))


@query("SELECT p_name, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY p_name")
def price_ranges(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))


@query("SELECT lang, source, count(*) AS n, round(count(*) FILTER (n_chars > 1000) / greatest(1, count(*)), 4) AS long_ratio FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def dataset_stats(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.documents.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(n.alias("n"), metrics.ratio(F.count_if(F.col("n_chars") > 1000), n).alias("long_ratio"))


@query("""SELECT doc_id, lang, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def stratified_split(t: Tables) -> DataFrame:
    return metrics.split(t.documents, "lang", F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))), "doc_id").select("doc_id", "lang", "split")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS i FROM documents) WHERE i <= 20")
def balanced_sample(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return t.documents.select("doc_id", "source", F.row_number().over(w).alias("i")).where("i <= 20").drop("i")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def first_occurrences(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT p_partkey, p_name || CASE WHEN r > 1 THEN ' #' || p_partkey ELSE '' END AS name, p_name AS stripped FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def duplicate_suffixes(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    name = F.when(F.row_number().over(w) > 1, F.concat("p_name", F.lit(" #"), F.col("p_partkey"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", name.alias("name")).withColumn("stripped", F.regexp_replace("name", r"\s+#\d+$", ""))


@query(f"WITH {UTTERANCES_SQL} SELECT utter_id, kind, text FROM utterances")
def template_expansion(t: Tables) -> DataFrame:
    return utterances(t).select("utter_id", "kind", "text")


@query("SELECT i AS case_id, item_id, length(text) AS n FROM range(500) r(i) JOIN benchmark ON item_id = i % (SELECT count(*) FROM benchmark)")
def cyclic_workload(t: Tables) -> DataFrame:
    n = t.benchmark.agg(F.count("*").alias("n"))
    cases = t.spark.range(500).withColumnRenamed("id", "case_id").join(F.broadcast(n), F.lit(True))
    return cases.join(t.benchmark, F.col("case_id") % F.col("n") == F.col("item_id")).select("case_id", "item_id", F.length("text").alias("n"))


@query("""SELECT 'unknown_lang' AS rule, count(*) FILTER (lang NOT IN ('en', 'fr')) AS violations FROM documents UNION ALL SELECT 'empty_text', count(*) FILTER (text = '') FROM documents
UNION ALL SELECT 'wrong_length', count(*) FILTER (n_chars <> length(text)) FROM documents UNION ALL SELECT 'short', count(*) FILTER (length(text) < 100) FROM documents
UNION ALL SELECT 'duplicate_text', count(*) - count(DISTINCT text) FROM documents""")
def quality_gates(t: Tables) -> DataFrame:
    d = t.documents
    rules = {"unknown_lang": F.col("lang").isin("en", "fr"), "empty_text": F.col("text") != "", "wrong_length": F.col("n_chars") == F.length("text"), "short": F.length("text") >= 100}
    copies = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return metrics.violations(d, rules).unionByName(copies.select(F.lit("duplicate_text").alias("rule"), "violations"))


@query("""SELECT conv_id, turn, len(ids)::INT AS n, sum_ids, masked FROM (
  SELECT conv_id, turn, list_slice(w, 1, 64) AS ids, list_sum(list_slice(w, 1, 64))::BIGINT AS sum_ids, least(64, p)::INT AS masked FROM (
    SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS w, len(string_split(text, ' ')) // 2 AS p FROM conversations))""")
def prompt_masking(t: Tables) -> DataFrame:
    """Token ids (here word lengths) cut to 64; labels of the prompt, here the first half, are -100."""
    c = t.conversations.select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("w"))
    prompt = F.floor(F.size("w") / 2).cast("int")
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), prompt), F.slice("w", prompt + 1, F.size("w"))), 1, 64)
    ids = F.slice("w", 1, 64)
    masked = F.size(F.filter(labels, lambda x: x == -100))
    return c.select("conv_id", "turn", F.size(ids).alias("n"), F.aggregate(ids, F.lit(0), lambda s, x: s + x).cast("long").alias("sum_ids"), masked.alias("masked"))


@query("""WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS ws FROM part), q AS (SELECT DISTINCT ws[1] AS w FROM n)
SELECT w, count(*) AS fits FROM q JOIN n ON list_contains(ws, w) GROUP BY w""")
def subset_join(t: Tables) -> DataFrame:
    """Names whose words hold all of a query's; the words carry an equi-join and the count of matches decides."""
    n = t.part.select("p_name", F.split("p_name", " ").alias("ws")).distinct()
    q = n.select(F.slice("ws", 1, 1).alias("q")).distinct()
    words = n.select("p_name", F.explode(F.array_distinct("ws")).alias("w"))
    asked = q.select("q", F.size("q").alias("k"), F.explode("q").alias("w"))
    full = asked.join(words, "w").groupBy("q", "k", "p_name").agg(F.count("*").alias("n")).where("n = k")
    return full.groupBy("q").agg(F.count("*").alias("fits")).select(F.col("q")[0].alias("w"), "fits")


WORDS_SQL = r"list_filter(string_split_regex(trim(lower(text)), '\s+'), lambda w: w <> '')"


@query(f"""WITH v AS (SELECT DISTINCT unnest({WORDS_SQL}) AS w FROM documents), a AS (SELECT DISTINCT conv_id, turn, unnest({WORDS_SQL}) AS w FROM conversations)
SELECT conv_id, turn, w FROM a WHERE w NOT IN (SELECT w FROM v)""")
def unknown_words(t: Tables) -> DataFrame:
    """Words of messages that no document has."""
    words = lambda df, *keys: df.select(*keys, F.explode(tx.tokens(F.lower("text"))).alias("w")).distinct()
    return words(t.conversations, "conv_id", "turn").join(words(t.documents), "w", "left_anti").select("conv_id", "turn", "w")


@query(f"""SELECT id, ['latte', 'green tea', 'mocha'][id % 3 + 1] AS name, (20 + (id * 7) % 40) * 1000 + [0, 5000, 10000][id % 3 + 1] AS price, ['S', 'M', 'L'][id % 3 + 1] AS size,
  CASE WHEN contains(['latte', 'green tea', 'mocha'][id % 3 + 1], 'tea') THEN 'tea' ELSE 'coffee' END AS entity FROM range(120) r(id)""")
def generated_catalog(t: Tables) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % 3 + 1).cast("int"))
    rows = t.spark.range(120).select("id", pick(["latte", "green tea", "mocha"]).alias("name"), ((20 + (F.col("id") * 7) % 40) * 1000 + pick([0, 5000, 10000])).alias("price"), pick(["S", "M", "L"]).alias("size"))
    return rows.withColumn("entity", F.when(F.col("name").contains("tea"), "tea").otherwise("coffee"))


@query("""WITH e AS (SELECT event_id % 10 = 3 AS hard, event_id % 7 <> 0 AS p, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_type <> 'error' AS v,
  event_type IN ('click', 'view') AS a, event_id % 5 <> 1 AS b FROM events),
m AS (SELECT hard, unnest([{'m': 'parse_rate', 'x': p}, {'m': 'valid_rate', 'x': v}, {'m': 'all_fields', 'x': v AND a AND b}, {'m': 'cache_relevant', 'x': v AND a}, {'m': 'field_intent', 'x': v AND a}, {'m': 'field_k', 'x': v AND b}]) AS r FROM e)
SELECT 'all' AS slice, r.m AS metric, count(*) AS n, round(avg(r.x::INT), 4) AS value FROM m GROUP BY ALL UNION ALL SELECT 'hard', r.m, count(*), round(avg(r.x::INT), 4) FROM m WHERE hard GROUP BY ALL""")
def field_metrics(t: Tables) -> DataFrame:
    """Structured predictions against what was wanted: here one in seven does not parse, one in eleven lacks a field, and errors are no valid intent."""
    i, k = F.col("event_type").alias("intent"), (F.col("event_id") % 5).alias("k")
    whole = F.concat(F.lit("sure: "), F.to_json(F.struct(i, k)), F.lit(" done"))
    raw = F.when(F.col("event_id") % 7 == 0, "{").when(F.col("event_id") % 11 == 0, F.to_json(F.struct(i))).otherwise(whole)
    rows = t.events.select(
        raw.alias("raw"), (F.col("event_id") % 10 == 3).alias("hard"),
        F.when(F.col("event_type").isin("click", "view", "error"), F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" #4"))).otherwise("other").alias("want_intent"),
        F.when(F.col("event_id") % 5 == 1, "9").otherwise((F.col("event_id") % 5).cast("string")).alias("want_k"),
    )
    return metrics.field_matches(rows, ["intent", "k"], ["intent"], {"intent": ["click", "purchase", "signup", "view"]})


assert len(TRUTH) == len(TEMPLATES)
