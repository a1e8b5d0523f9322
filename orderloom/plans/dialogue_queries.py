"""Routing, extraction, orders, text and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx
from orderloom.operators import intents
from orderloom.plans.base import UTTERANCES_SQL, Tables, as_text, query, sql_any, sql_hits, utterances
from orderloom.streaming import sessions

W = r"[^\p{L}\p{N}_]"
BOUNDARY = r"\b"


def _score_sql(intent: str) -> str:
    n = sql_hits("t", lx.ROUTER_KEYWORDS[intent])
    return f"{n} AS n_{intent}"


#: The router over utterances. Their templates hold no question that only an availability pattern would take for an order, but one kind.
ROUTER_SQL = f"""{UTTERANCES_SQL},
r0 AS (SELECT *, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS t FROM utterances),
r1 AS (SELECT *, {', '.join(_score_sql(i) for i in lx.INTENTS)}, {sql_any('t', lx.MENU_HINTS)} AS hint, {sql_any('t', lx.QUESTION_MARKERS)} AS asks,
  {sql_any('t', lx.PREFERENCE_WORDS)} AS pref, regexp_matches(t, '(^|{W})(1|2|3|4|5|một|hai|ba|bốn|năm)($|{W})') AS num FROM r0),
r2 AS (SELECT *, {', '.join(f"CASE WHEN n_{i} > 0 THEN {lx.BASE_SCORES[i]} + least({lx.MAX_EXTRA_BONUS}, {lx.EXTRA_MATCH_BONUS} * (n_{i} - 1)) ELSE 0 END::DOUBLE AS b_{i}" for i in lx.INTENTS)} FROM r1),
r3 AS (SELECT *, CASE WHEN hint AND n_faq = 0 AND n_consultant = 0 THEN greatest(b_order + CASE WHEN hint AND num THEN 0.2 ELSE 0 END, 0.55) ELSE b_order + CASE WHEN hint AND num THEN 0.2 ELSE 0 END END::DOUBLE AS s_order,
  (b_consultant + CASE WHEN asks AND hint AND pref THEN 0.15 ELSE 0 END)::DOUBLE AS s_consultant, b_faq AS s_faq,
  (b_ignore + CASE WHEN length(t) <= 8 AND n_ignore > 0 THEN 0.25 ELSE 0 END)::DOUBLE AS s_ignore FROM r2),
r4 AS (SELECT *, greatest(s_order, s_consultant, s_faq, s_ignore) AS best,
  n_faq = 0 AND n_consultant = 0 AND hint AND regexp_matches(t, '^(có|còn)\\s+.+\\s+(không|ko|k|hông|chưa)(\\s+(ạ|nhỉ|vậy))*\\s*\\??$') AS available,
  round(s_order, 9) >= 0.7 AND NOT (n_faq > 0 AND asks AND NOT (hint AND num)) AS clear FROM r3),
routed AS (SELECT utter_id, item, quantity, size, kind, text,
  CASE WHEN available OR clear THEN 'order' WHEN best <= 0 THEN 'ignore' WHEN s_order = best THEN 'order' WHEN s_consultant = best THEN 'consultant' WHEN s_faq = best THEN 'faq' ELSE 'ignore' END AS intent,
  round(CASE WHEN available THEN 0.7 WHEN clear THEN least(s_order, 0.99) WHEN best > 0 THEN least(best, 0.99) ELSE 0.5 END, 4) AS confidence FROM r4)"""

#: The intents that the utterances' templates mean, by kind.
TRUTH = ["order", "consultant", "consultant", "faq", "ignore", "faq", "order", "order", "faq", "consultant", "order", "ignore", "order", "faq", "order", "ignore", "order"]


def routed(t: Tables) -> DataFrame:
    return intents.route(utterances(t))


@query(f"WITH {ROUTER_SQL} SELECT utter_id, intent, confidence FROM routed")
def rule_router(t: Tables) -> DataFrame:
    return routed(t).select("utter_id", "intent", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {UTTERANCES_SQL} SELECT utter_id, CASE WHEN v > e THEN 'vi' WHEN e > v THEN 'en' ELSE 'unknown' END AS marker, CASE WHEN regexp_matches(lower(text), '{lx.VI_DIACRITICS}') OR {sql_any('lower(text)', lx.EXTRACTOR_VI_MARKERS)} THEN 'vi' ELSE 'en' END AS diacritic "
       f"FROM (SELECT *, {sql_hits('lower(text)', lx.VI_MARKERS)} AS v, {sql_hits('lower(text)', lx.EN_MARKERS)} AS e FROM utterances)")  # fmt: skip
def languages(t: Tables) -> DataFrame:
    low = F.lower("text")
    return utterances(t).select("utter_id", tx.marker_language(low).alias("marker"), tx.diacritic_language(F.col("text")).alias("diacritic"))


@query()
def intent_extraction(t: Tables) -> DataFrame:
    return intents.extract(routed(t)).select("utter_id", "intent", "language", "subject", "context", "action", "cache_key", "extraction_confidence")


def menu(t: Tables) -> DataFrame:
    """The shop's menu: the parts' distinct names in three sizes."""
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_retailprice").alias("p"))
    sizes = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(i).alias("more")) for i, s in enumerate(["S", "M", "L"])]))
    return names.select("name", "p", sizes.alias("v")).select("name", "v.size", (F.floor("p") + F.col("v.more") * 5000).cast("int").alias("price"), F.lit(True).alias("available"))


def resolved(t: Tables) -> DataFrame:
    return intents.resolve_orders(utterances(t).select(F.col("utter_id").alias("query_id"), "text", "kind"), menu(t))


@query(f"""WITH {UTTERANCES_SQL}, m AS (SELECT p_name, floor(min(p_retailprice))::INT AS p FROM part GROUP BY p_name)
SELECT utter_id AS query_id, 'confirm' AS action, item, size, quantity::INT AS quantity, p + CASE size WHEN 'S' THEN 0 WHEN 'M' THEN 5000 ELSE 10000 END AS price
FROM utterances JOIN m ON p_name = item WHERE kind IN (0, 6)""")
def order_slots(t: Tables) -> DataFrame:
    return resolved(t).where("kind in (0, 6)").select("query_id", "action", "item", "size", "quantity", "price")


@query()
def order_resolution(t: Tables) -> DataFrame:
    return resolved(t).select("query_id", "action", "item", "size", "quantity", "price", as_text(F.col("choices")).alias("choices"), as_text(F.col("unknown_words")).alias("unknown_words"))


@query(f"WITH {UTTERANCES_SQL} SELECT utter_id, 'faq:' || trim(regexp_replace(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), '[?!。！？]+$', '')) AS key FROM utterances")
def cache_keys(t: Tables) -> DataFrame:
    return utterances(t).select("utter_id", tx.cache_key(F.lit("faq"), F.col("text")).alias("key"))


@query(f"""WITH {UTTERANCES_SQL}, x AS (SELECT *, trim(regexp_replace(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), '[?!。！？]+$', '')) AS c FROM utterances)
SELECT utter_id, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(c, '{'|'.join(p.removeprefix(BOUNDARY).removesuffix(BOUNDARY) for p in ps)}') THEN '{tag}' END" for tag, ps in lx.DOMAIN_TAGS.items())}) AS tags FROM x""")
def domain_tags(t: Tables) -> DataFrame:
    """In these utterances wifi is always a word of its own, so the SQL needs no word boundaries, which its engine has for ASCII letters only."""
    return utterances(t).select("utter_id", as_text(intents.domain_tags(F.col("text"))).alias("tags"))


LOWER_WORDS = r"list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g')), '\s+'), lambda w: w <> '')"


@query(f"""WITH {UTTERANCES_SQL}, x AS (SELECT utter_id, text, list_filter({LOWER_WORDS}, lambda w: NOT list_contains({[*lx.STOPWORDS]}, w) AND NOT regexp_matches(w, '^[0-9]+$')) AS ws FROM utterances)
SELECT utter_id, CASE WHEN len(ws) = 0 THEN text ELSE array_to_string(ws, ' ') END AS clean FROM x""")
def clean_queries(t: Tables) -> DataFrame:
    return utterances(t).select("utter_id", tx.clean_query(F.col("text")).alias("clean"))


@query(r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice::BIGINT AS v FROM lineitem),
y AS (SELECT *, replace(format('{:,}', v), ',', '.') || 'đ' AS vnd FROM x)
SELECT l_orderkey, l_linenumber, vnd, 'giá ' || CASE WHEN v BETWEEN 1000 AND 999999 THEN (v // 1000) || 'k' WHEN v < 1000 THEN vnd ELSE (v // 1000000) || '.' || lpad((v // 1000 % 1000)::VARCHAR, 3, '0') || 'k' END || ', thuế, size mờ' AS spoken FROM y""")
def price_texts(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.bround("l_extendedprice").cast("long").alias("v"))
    vnd = tx.vnd(F.col("v"))
    return x.select("l_orderkey", "l_linenumber", vnd.alias("vnd"), tx.spoken(F.concat(F.lit("giá "), vnd, F.lit(", vat, Size M"))).alias("spoken"))


@query("SELECT p_partkey, lower(p_type) || ' and fine' AS short FROM part")
def short_descriptions(t: Tables) -> DataFrame:
    c = F.concat("p_name", F.lit(" (size M) — "), F.lower("p_type"), F.lit(" and fine. More — here. "))
    return t.part.select("p_partkey", tx.short_description(c).alias("short"))


@query(rf"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '(?s)[^,.?!;:。！？؛،]*[,.?!;:。！？؛،]+') AS m, trim(regexp_replace(text, '(?s)^.*[,.?!;:。！？؛،]+', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest FROM documents),
y AS (SELECT doc_id, list_filter(list_transform(m, lambda c: trim(c, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda c: length(c) >= 12) AS k, rest FROM x)
SELECT doc_id, len(k) + (rest <> '')::INT AS n, md5(array_to_string(CASE WHEN rest <> '' THEN list_append(k, rest) ELSE k END, '|')) AS clauses FROM y""")
def clause_split(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", tx.clauses(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|")).alias("clauses"))


@query("""SELECT conv_id, turn, p::INT AS seq, w || ' ' AS token FROM (
  SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM (
    SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations))""")
def token_stream(t: Tables) -> DataFrame:
    words = t.conversations.select("conv_id", "turn", F.posexplode(tx.tokens(F.col("text"))).alias("seq", "w"))
    return words.select("conv_id", "turn", "seq", F.concat("w", F.lit(" ")).alias("token"))


@query("""SELECT event_id, 'data: {"type":"' || event_type || '","data":"' || user_id || '"}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(t: Tables) -> DataFrame:
    return t.events.select("event_id", tx.sse_frame(F.col("event_type"), F.col("user_id").cast("string")).alias("frame"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_id % 7 <> 0")
def sse_decode(t: Tables) -> DataFrame:
    """Frames back to values; frames cut in half, here one in seven, are skipped."""
    frame = F.concat(F.lit("data: "), F.to_json(F.struct("event_type", F.col("props").alias("body"))))
    sent = t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring(frame, 1, 15)).otherwise(frame).alias("line"))
    body = F.try_parse_json(F.regexp_extract("line", "(?s)^data: (.*)$", 1))
    found = sent.select("event_id", body.alias("v")).where("v is not null")
    return found.select("event_id", F.try_variant_get("v", "$.event_type", "string").alias("event_type"), F.get_json_object(F.try_variant_get("v", "$.body", "string"), "$.k").cast("int").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def json_recovery(t: Tables) -> DataFrame:
    """Objects inside other text are found; broken ones are not."""
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("sure: "), "props", F.lit(" done"))).otherwise(F.substring("props", 1, 4))
    return t.events.select("event_id", F.get_json_object(tx.json_object(text), "$.k").alias("k"))


@query("""SELECT conv_id, turn, coalesce(len(h), 0)::INT AS n, coalesce(md5(array_to_string(h, '|')), '') AS window_md5 FROM (
  SELECT conv_id, turn, list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM conversations)""")
def trailing_messages(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-lx.HISTORY_WINDOW, -1)
    h = t.conversations.select("conv_id", "turn", F.collect_list(F.concat_ws(":", "role", "text")).over(w).alias("h"))
    return h.select("conv_id", "turn", F.size("h").alias("n"), F.when(F.size("h") > 0, F.md5(F.array_join("h", "|"))).otherwise("").alias("window_md5"))


@query("""SELECT conv_id, len(s)::INT AS n, array_to_string(CASE WHEN len(s) > 3 THEN [s[1], s[-2], s[-1]] ELSE s END, ' ') AS q FROM (
  SELECT conv_id, list(turn::VARCHAR ORDER BY turn) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def query_segments(t: Tables) -> DataFrame:
    s = F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string"))
    u = t.conversations.where("role = 'user'").groupBy("conv_id").agg(s.alias("s"))
    kept = F.when(F.size("s") > lx.MAX_SEGMENTS, F.concat(F.slice("s", 1, 1), F.slice("s", -(lx.MAX_SEGMENTS - 1), lx.MAX_SEGMENTS - 1))).otherwise(F.col("s"))
    return u.select("conv_id", F.size("s").alias("n"), F.array_join(kept, " ").alias("q"))


@query("""SELECT event_id, coalesce(n - last_value(CASE WHEN event_type = 'purchase' THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS gap
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def turn_gap(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = t.events.withColumn("n", F.row_number().over(w.orderBy("ts", "event_id")).cast("long"))
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("n")), ignorenulls=True).over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return e.select("event_id", F.coalesce(F.col("n") - last, F.lit(-1)).alias("gap"))


@query("SELECT conv_id, turn, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS tokens FROM conversations")
def history_tokens(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.sum(tx.token_estimate(F.col("text"))).over(w).alias("tokens"))


@query("""SELECT event_id, user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS session
FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1800 SECONDS)::INT, 0) AS n FROM events)""")
def sessions_by_gap(t: Tables) -> DataFrame:
    e = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return sessions.sessionize(e, "user_id", "at").select("event_id", "user_id", "session")


@query("""SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (
  SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1800 SECONDS)::INT, 0) AS x FROM events)) GROUP BY user_id, s""")
def session_windows(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("at"))
    found = sessions.session_windows(e, "user_id", "at")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_requests(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", F.bround(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("s"))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)).alias("n"))


def requests(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))


@query()
def rate_limiter(t: Tables) -> DataFrame:
    return sessions.rate_limit(requests(t), "user_id", "seconds", 2, 86400.0, "event_id").select("event_id", "allowed")


@query()
def exact_cache_replay(t: Tables) -> DataFrame:
    return sessions.exact_cache(requests(t), "user_id", "event_id", "seconds", "event_type", ttl=3 * 86400, size=3).select("event_id", "hit", "hits")


@query()
def semantic_cache_replay(t: Tables) -> DataFrame:
    e = t.embeddings.select("label", "vec_id", F.col("vec_id").cast("double").alias("seconds"), F.col("vec_id").cast("string").alias("key"), "embedding")
    return sessions.semantic_cache(e, "label", "vec_id", "seconds", "key", "embedding", threshold=0.6, ttl=1800).select("vec_id", "hit", "matched")


def turns(t: Tables) -> DataFrame:
    return routed(t).withColumn("session", F.expr("utter_id div 17")).withColumn("turn", F.col("utter_id") % 17)


@query()
def follow_ups(t: Tables) -> DataFrame:
    return sessions.follow_ups(turns(t).select("session", "turn", "text", "intent", "weak"))


@query()
def order_dialogues(t: Tables) -> DataFrame:
    own = turns(t).select("utter_id", "session", "turn", "intent")
    slots = resolved(t).select(F.col("query_id").alias("utter_id"), "text", "action", "item", "size", "quantity", "price")
    return sessions.dialogues(own.join(slots, "utter_id"))


@query()
def history_summaries(t: Tables) -> DataFrame:
    return sessions.summaries(t.conversations.select(F.col("conv_id").alias("session"), "turn", F.repeat("text", 8).alias("text")))


@query("""SELECT conv_id, turn, role, length(text) AS n FROM (
  SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE turn >= f""")
def model_messages(t: Tables) -> DataFrame:
    return messages_for_model(t.conversations).select("conv_id", "turn", "role", F.length("text").alias("n"))


def messages_for_model(log: DataFrame) -> DataFrame:
    """conv_id, turn, role and text for a model: roles filtered, blank ones dropped, and all of the assistant's before the first of the user."""
    m = log.where("role in ('user', 'assistant') and trim(text) <> ''")
    h = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    first = F.array_position(F.transform("h", lambda x: x["role"]), "user").cast("int")
    kept = F.when(first > 0, F.slice("h", F.greatest(first, F.lit(1)), F.size("h")))
    return h.select("conv_id", F.explode(kept).alias("m")).select("conv_id", "m.*")
