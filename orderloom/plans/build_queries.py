"""Event streams, chains of models, dataset builds, message logs, metadata and vector cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import metadata
from orderloom.functions import text as tx
from orderloom.operators import datasets, models, retrieval, vector_index
from orderloom.plans.base import Tables, query, rounded
from orderloom.plans.catalog_queries import vectors
from orderloom.plans.dialogue_queries import ROUTER_SQL, TRUTH, resolved, routed
from orderloom.streaming import protocol

MARKS = lx.CLAUSE_MARKS.removesuffix("+")
NOT_MARKS = MARKS.replace("[", "[^", 1)
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(rf"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN conv_id % 9 END AS f, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM conversations),
c AS (SELECT conv_id, turn, f, CASE WHEN f IS NULL THEN ws ELSE ws[1:f] END AS ws FROM a),
s AS (SELECT *, array_to_string(ws, ' ') || ' ' AS s FROM c WHERE len(ws) > 0),
m AS (SELECT *, regexp_extract_all(s, '(?s){NOT_MARKS}*{MARKS}+') AS m, trim(regexp_replace(s, '(?s)^.*{MARKS}+', ''), {BLANKS}) AS rest FROM s),
x AS (SELECT conv_id, turn, i, trim(m[i], {BLANKS}) AS clause, len(string_split(array_to_string(m[1:i], ''), ' ')) - 1 AS place FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
e AS (
  SELECT conv_id, turn, -1 AS place, 0 AS kind, 0 AS sub, 'METADATA' AS event, round((turn + 0.25::DOUBLE) * 1000, 2)::VARCHAR AS data FROM s
  UNION ALL SELECT conv_id, turn, i - 1, 1, 0, 'TOKEN', ws[i] || ' ' FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c)
  UNION ALL SELECT conv_id, turn, place, 2, i, 'CLAUSE', clause FROM x WHERE length(clause) >= {lx.CLAUSE_MIN}
  UNION ALL SELECT conv_id, turn, len(ws), 3, 0, 'ERROR', '{protocol.STREAM_ERROR}' FROM c WHERE f IS NOT NULL
  UNION ALL SELECT conv_id, turn, len(ws), 4, 0, 'CLAUSE', rest FROM m WHERE rest <> '' UNION ALL SELECT conv_id, turn, {protocol.LAST}, 5, 0, 'DONE', '{protocol.DONE}' FROM c)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY place, kind, sub) - 1)::INT AS n, event, CASE WHEN event = 'METADATA' THEN data::DOUBLE::VARCHAR ELSE data END AS data FROM e""")
def answer_stream(t: Tables) -> DataFrame:
    """All turns as event streams; one in four fails after some tokens, or before the first."""
    fails = F.when(F.col("turn") % 4 == 3, F.col("conv_id") % 9)
    answers = t.conversations.select("conv_id", "turn", "text", F.lit(0.0).alias("started"), (F.col("turn") + 0.25).cast("double").alias("first_at"), fails.cast("int").alias("fails_at"))
    return protocol.answer_events(answers, ["conv_id", "turn"])


def word_model(name: str, words: dict[str, str]):
    """A stand-in for a trained router: the first of its words in a text gives the label; unsure of short texts."""
    predict = lambda model, texts: [next(((label, 0.9 if len(x) > 12 else 0.4) for word, label in model.items() if word in x.lower()), (None, None)) for x in texts]
    return models.labeler(name, lambda: words, predict)


MODEL_WORDS = {"wifi": "faq", "không": "consultant", "tea": "consultant", "giờ": "faq"}


@query(f"""WITH {ROUTER_SQL},
m AS (SELECT *, CASE {' '.join(f"WHEN contains(lower(text), '{w}') THEN '{x}'" for w, x in MODEL_WORDS.items())} END AS said FROM routed),
d AS (SELECT *, CASE WHEN said IS NOT NULL AND length(text) > 12 THEN 'model' WHEN confidence >= 0.6 THEN 'rules' ELSE 'fallback' END AS stage FROM m)
SELECT utter_id, CASE stage WHEN 'model' THEN said WHEN 'rules' THEN intent ELSE 'ignore' END AS label, CASE stage WHEN 'model' THEN 0.9 WHEN 'rules' THEN confidence ELSE 0 END::DOUBLE AS confidence, stage FROM d""")
def router_chain(t: Tables) -> DataFrame:
    """A model first, the rules for what it leaves open, a fixed answer for the rest."""
    rows = routed(t).select("utter_id", "text", F.struct(F.col("intent").alias("label"), F.col("confidence").cast("double").alias("confidence")).alias("rules"))
    rules = lambda text: F.when(text.isNotNull(), F.col("rules"))
    stages = [models.Stage("model", word_model("words", MODEL_WORDS), lx.INTENTS, 0.5), models.Stage("rules", rules, lx.INTENTS, 0.6)]
    found = models.chain(rows, "text", stages, "ignore")
    return found.select("utter_id", "label", F.round("confidence", 4).alias("confidence"), "stage")


@query(f"""WITH {ROUTER_SQL},
c AS (SELECT utter_id AS id, {TRUTH}[kind + 1] AS intent, CASE WHEN kind IN (2, 4, 6, 9, 15) THEN 'en' ELSE 'vi' END AS language, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, md5('d' || utter_id) AS o FROM utterances),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, id) AS r FROM c) WHERE r = 1),
q AS (SELECT unnest(['order', 'consultant', 'faq', 'ignore']) AS intent, count(*) // 20 AS total FROM part GROUP BY 1),
quotas AS (SELECT intent, 'en' AS language, (total * 0.3::DOUBLE)::DOUBLE AS x, floor(total * 0.3::DOUBLE)::BIGINT AS quota, total FROM q
  UNION ALL SELECT intent, 'vi', 0, total - floor(total * 0.3::DOUBLE)::BIGINT, total FROM q),
p AS (SELECT one.*, quota, row_number() OVER (PARTITION BY intent, language ORDER BY o, id) AS place, least(quota, count(*) OVER (PARTITION BY intent, language)) AS have FROM one JOIN quotas USING (intent, language)),
u AS (SELECT *, unnest(range(1, ((quota - place) // have + 2)::BIGINT)) AS time FROM p WHERE place <= quota)
SELECT id AS sample_id, intent, language, CASE WHEN time > 1 THEN text || ' #' || time ELSE text END AS text FROM u""")
def quota_dataset(t: Tables) -> DataFrame:
    """A dataset of as many samples of each intent, seven in ten Vietnamese, from the utterances; where there are too few, they come again under numbers."""
    intent = F.element_at(F.array(*map(F.lit, TRUTH)), F.col("kind") + 1)
    c = routed(t).select(F.col("utter_id").alias("id"), intent.alias("intent"), F.when(F.col("kind").isin(2, 4, 6, 9, 15), "en").otherwise("vi").alias("language"), "text")
    total = t.part.count() // 20
    english = int(total * 0.3)
    quotas = datasets.quota_table(t.spark, {(i, lang): n for i in lx.INTENTS for lang, n in (("vi", total - english), ("en", english))})
    return datasets.fill(c, quotas, F.md5(F.concat(F.lit("d"), F.col("id").cast("string")))).drop("time")


LOG_SQL = """log AS (SELECT user_id, event_id % 40 AS message, event_id // 7 AS version, event_id AS seq, ['append', 'update', 'append', 'delete', 'drop'][CASE WHEN event_id % 97 = 0 THEN 5 ELSE event_id % 4 + 1 END] AS op, event_type AS body FROM events)"""


def message_log(t: Tables) -> DataFrame:
    op = F.when(F.col("event_id") % 97 == 0, "drop").otherwise(F.element_at(F.array(*map(F.lit, ["append", "update", "append", "delete"])), (F.col("event_id") % 4 + 1).cast("int")))
    return t.events.select("user_id", (F.col("event_id") % 40).alias("message"), F.floor(F.col("event_id") / 7).alias("version"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("body"))


@query(f"""WITH {LOG_SQL},
own AS (SELECT l.*, gone FROM log l LEFT JOIN (SELECT user_id, max(version) AS gone FROM log WHERE op = 'drop' GROUP BY user_id) USING (user_id) WHERE op <> 'drop'),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, message ORDER BY version DESC, seq DESC) AS r, bool_or(op = 'append') OVER (PARTITION BY user_id, message) AS is FROM own WHERE gone IS NULL OR version > gone)
SELECT user_id, message, version, body FROM k WHERE r = 1 AND "is" AND op <> 'delete'""")
def live_messages(t: Tables) -> DataFrame:
    """The messages that a log of appends, updates, deletions and dropped sessions leaves; versions tie."""
    return datasets.compact_messages(message_log(t), ["user_id", "message"], "user_id").select("user_id", "message", "version", "body")


@query("""WITH x AS (SELECT event_id, props::JSON AS a, json_object('cache', json_object('hit', event_id % 2 = 0, 'tier', json_object('name', event_type)), 'k', 'own') AS b,
  json_object('cache', json_object('tier', json_object('size', event_id % 5)), 'list', json_array(1, event_id % 3)) AS c FROM events),
m AS (SELECT event_id, json_merge_patch(json_merge_patch(a, CASE WHEN event_id % 6 = 5 THEN '{}'::JSON ELSE b END), c) AS j FROM x)
SELECT event_id, j->>'$.k' AS k, j->>'$.cache.hit' AS hit, j->>'$.cache.tier.name' AS tier, (j->>'$.cache.tier.size')::INT AS size, j->>'$.list[1]' AS last FROM m""")
def merged_metadata(t: Tables) -> DataFrame:
    """Three objects of metadata an event, merged: later keys win, nested objects merge; one in six is broken and changes nothing."""
    b = F.to_json(F.struct(F.struct((F.col("event_id") % 2 == 0).alias("hit"), F.struct(F.col("event_type").alias("name")).alias("tier")).alias("cache"), F.lit("own").alias("k")))
    c = F.to_json(F.struct(F.struct(F.struct((F.col("event_id") % 5).alias("size")).alias("tier")).alias("cache"), F.array(F.lit(1), F.col("event_id") % 3).alias("list")))
    j = t.events.select("event_id", metadata.merge_json(F.col("props"), F.when(F.col("event_id") % 6 == 5, "{").otherwise(b), c).alias("j"))
    at = lambda path: F.get_json_object("j", f"$.{path}")
    return j.select("event_id", at("k").alias("k"), at("cache.hit").alias("hit"), at("cache.tier.name").alias("tier"), at("cache.tier.size").cast("int").alias("size"), at("list[1]").alias("last"))


@query("""WITH m AS (SELECT p_name, count(DISTINCT p_size % 3) AS n FROM part GROUP BY p_name)
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS item, CASE WHEN p_partkey % 4 <> 0 AND n > 1 THEN ['S', 'M', 'L'][p_size % 3 + 1] END AS size, n::INT AS sizes,
  CASE WHEN p_partkey % 4 <> 0 THEN (p_size % 5 + 1)::INT END AS quantity FROM part JOIN m USING (p_name)""")
def order_metadata(t: Tables) -> DataFrame:
    """Metadata of orders: the line of those that wait for a yes, with its size where the item has several."""
    size = F.element_at(F.array(*map(F.lit, ["S", "M", "L"])), (F.col("p_size") % 3 + 1).cast("int"))
    p = t.part.select(F.col("p_partkey").alias("id"), "p_name", size.alias("size"), (F.col("p_size") % 5 + 1).cast("int").alias("quantity"), F.when(F.col("p_partkey") % 4 != 0, "confirm").otherwise("ask_size").alias("action"), F.floor("p_retailprice").cast("int").alias("price"))
    sizes = p.groupBy("p_name").agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    c = F.col
    j = p.join(sizes, "p_name").select("id", metadata.order_line(c("action"), c("p_name"), c("size"), c("quantity"), c("price"), c("sizes")).alias("j"))
    at = lambda path: F.get_json_object("j", f"$.{path}")
    sizes_of = F.size(F.from_json(at("available_sizes"), "array<string>"))
    return j.select("id", at("line.item").alias("item"), at("line.size").alias("size"), sizes_of.alias("sizes"), at("line.quantity").cast("int").alias("quantity"))


@query()
def vector_cells(t: Tables) -> DataFrame:
    """Search in stored cells: the five best of each query, by vectors."""
    q, n = vectors(t)
    found = vector_index.search(q, vector_index.build(n), lx.TOP_K)
    return rounded(retrieval.top(found, lx.TOP_K).select("query_id", "source_id", "score"), "score")


@query()
def vector_cells_recall(t: Tables) -> DataFrame:
    """How many of the exact search's hits the search in cells finds: queries, wanted, found and recall."""
    q, n = vectors(t)
    found = vector_index.search(q, vector_index.build(n), lx.TOP_K)
    told = vector_index.recall(found, retrieval.vector_hits(q, n, lx.TOP_K))
    return told.withColumn("recall", F.round(F.col("found") / F.greatest(F.lit(1), "wanted"), 4))
