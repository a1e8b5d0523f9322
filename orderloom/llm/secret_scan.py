"""Secret scans with corpus-wide ownership frequency.

Patterns give candidates: three base kinds, which are always reported, and two
wider ones. Candidate values are hashed, and their hashes are counted over the
whole corpus by distinct owners and by distinct repositories (of each owner). A
value that COPIED_OWNERS owners or COPIED_REPOSITORIES repositories hold is a copied
example; any other that looks random is taken for a live credential, values of two
owners included. Spans of the wider kinds are reported only where live.

Texts are searched once: spans of all rows are written, and judging reads those.
Rows without candidates, nearly all, are never shuffled. The counts are
pre-aggregated by (value, owner, repository), so a value that a third of all
documents hold arrives as one row per task, and the join that carries them back
is a plain one that Spark can split where it is skewed.

Null text has no spans. Null owners and repositories count as one of their own.
Repeated rows are scanned each. redact() gives the documents' own columns back
under any names; scan() adds the four columns it states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import materialize, table, text_of
from orderloom.llm.spans import Kind, apart_from, listed, masked, with_spans

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (
    Kind("assign", ASSIGN, None, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]+", lambda t: t.contains("AKIA"), lambda v: F.length(v) >= 20),
    Kind("hex", r"[0-9a-f]{24,}+"),  # runs of the class are matched whole, so shorter ones drop out
)
WIDER = (
    Kind("issued", r"(?:gh[oprsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)"),
    Kind("opaque", r"[A-Za-z0-9+/_-]{24,}+"),
)
MARK = "[SECRET]"
#: Values that this many owners hold are copied examples.
COPIED_OWNERS = 3
#: Values that so many repositories of fewer owners hold are copied examples too.
COPIED_REPOSITORIES = 10


def secret_part(kind: Column, value: Column) -> Column:
    """The credential itself: what an assignment assigns, else the whole match."""
    return F.when(kind == "assign", F.regexp_extract(value, ASSIGN, 2)).otherwise(value)


def looks_random(value: Column) -> Column:
    """At least ten different characters, with a digit and a letter among them, and no long run of letters like a word's."""
    letters = F.array_distinct(F.split(value, ""))
    return (F.size(letters) >= 10) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("[a-z]{12}|[A-Z]{16}")


def mixed_case(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9].*[0-9]")


def ranked(spans: Column, rank: int) -> Column:
    """Spans that sort by start, then kind."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    )


def candidates(docs: DataFrame, text: str = "_text") -> DataFrame:
    """docs and two arrays of spans: base and wider, the latter apart from the former."""
    names = docs.columns
    found = with_spans(docs.select(*[F.col(c).alias(f"c_{c}") for c in names]), f"c_{text}", [*BASE, *WIDER])
    own = [F.col(f"c_{c}").alias(c) for c in names]
    base = F.concat(*[ranked(F.col(k.name), i) for i, k in enumerate(BASE)])
    found = found.select(*own, F.array_sort(base).alias("base"), "issued", F.filter("opaque", lambda s: mixed_case(s["value"])).alias("opaque"))
    first = apart_from(F.col("issued"), F.col("base"))
    found = found.select(*names, "base", first.alias("issued"), "opaque")
    other = apart_from(F.col("opaque"), F.concat(*[F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for c in ("base", "issued")]))
    wider = F.concat(ranked(F.col("issued"), len(BASE)), ranked(other, len(BASE) + 1))
    wider = F.filter(wider, lambda s: looks_random(s["value"]))
    return found.select(*names, "base", wider.alias("wider"))


def is_copied(owners: Column, repositories: Column) -> Column:
    """Whether a value is a copied example, by both counts."""
    return (owners >= COPIED_OWNERS) | (repositories >= COPIED_REPOSITORIES)


def ownership(cands: DataFrame) -> DataFrame:
    """hash, owners and repositories of candidate hashes; cands: hash, owner, repository."""
    seen = cands.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    return seen.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", with_text: bool = True) -> DataFrame:
    """docs (without text, if so asked) and: base, an array of spans; live, the spans taken for live credentials (of all kinds); n_copied, spans with copied examples; held, for each candidate its place and the owners and repositories of its value.

    Columns of docs by these four names are replaced; redact() keeps all.
    """
    names = [c for c in docs.columns if (with_text or c != text) and c.lower() not in ("base", "live", "n_copied", "held")]
    inner = docs.select(F.struct(*names).alias("doc"), text_of(text).alias("_text"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    found = candidates(inner).select("doc", "owner", "repository", "base", F.concat("base", "wider").alias("spans"), F.monotonically_increasing_id().alias("rid"))
    found = materialize(found, "secret-spans")
    kept = found.where(F.size("spans") > 0)
    span = F.explode("spans").alias("span")
    value = F.sha2(secret_part(F.col("span.kind"), F.col("span.value")), 256)
    cands = kept.select("rid", "owner", "repository", span).withColumn("hash", value)
    freq = ownership(cands.select("hash", "owner", "repository"))
    judged = cands.select("rid", "span", "hash").join(freq, "hash", "left")
    copied = is_copied(F.col("owners"), F.col("repositories"))
    live = ~copied & looks_random(secret_part(F.col("span.kind"), F.col("span.value")))
    by_doc = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(live, F.col("span")))).alias("live"),
        F.count(F.when(copied, True)).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("span.start", "span.end", "owners", "repositories"))).alias("held"),
    )
    some = kept.select("rid", "doc", "base").join(by_doc, "rid").select("doc.*", "base", "live", "n_copied", "held")
    empty = F.filter("base", lambda s: F.lit(False))
    none = found.where(F.size("spans") == 0).select("doc.*", "base", empty.alias("live"), F.lit(0).cast("long").alias("n_copied"), F.array().cast(some.schema["held"].dataType).alias("held"))
    return none.unionByName(some)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, with live credentials replaced by MARK; copied examples and everything else stay."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    found = scan(docs.select(*[F.col(c).alias(n) for c, n in own.items()]), own["text"], own["source"], own["doc_id"])
    text = F.when(F.size("live") > 0, masked(text_of(own["text"]), F.col("live"), MARK)).otherwise(F.col(own["text"]))
    return found.select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in own.items()])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    all_ = F.array_sort(F.array_union("base", "live"))
    held = F.transform("held", lambda h: F.concat_ws(":", h["start"], h["end"], h["owners"], h["repositories"]))
    return found.select(
        "doc_id", *[count(k.name) for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(all_).alias("spans"),
        F.size("live").cast("long").alias("n_live"), "n_copied", F.array_join(held, ",").alias("held"),
    )


def op2_sql() -> str:
    """The same result in DuckDB SQL."""
    quote = lambda p: "'" + p.replace("'", "''").replace("}+", "}") + "'"
    kinds = (*BASE, *WIDER)

    def spans(rank: int, kind: Kind) -> str:
        p = quote(kind.pattern)
        return f"""SELECT rid, {rank} AS rank, '{kind.name}' AS kind, unnest(m) AS value, unnest(list_transform(range(1, len(m) + 1),
      lambda i: (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT)) AS start
    FROM (SELECT rid, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS p FROM d)"""

    union = " UNION ALL ".join(spans(i, k) for i, k in enumerate(kinds))
    random_looking = "len(list_distinct(string_split({0}, ''))) >= 10 AND regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]') AND NOT regexp_matches({0}, '[a-z]{{12}}|[A-Z]{{16}}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS owner FROM documents),
raw AS (SELECT *, start + length(value) AS stop FROM ({union})),
base AS (SELECT *, CASE WHEN kind = 'assign' THEN regexp_extract(value, {quote(ASSIGN)}, 2) ELSE value END AS part FROM raw
  WHERE kind = 'hex' OR (kind = 'access' AND length(value) >= 20) OR (kind = 'assign' AND length(regexp_extract(value, {quote(ASSIGN)}, 2)) >= 6)),
issued AS (SELECT * FROM raw r WHERE kind = 'issued' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND r.start < b.stop AND b.start < r.stop)),
opaque AS (SELECT * FROM raw r WHERE kind = 'opaque' AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9].*[0-9].*[0-9]')
  AND NOT EXISTS (SELECT 1 FROM (SELECT rid, start, stop FROM base UNION ALL SELECT rid, start, stop FROM issued) b WHERE b.rid = r.rid AND r.start < b.stop AND b.start < r.stop)),
wider AS (SELECT *, value AS part FROM (SELECT * FROM issued UNION ALL SELECT * FROM opaque) WHERE {random_looking.format("value")}),
cands AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM wider),
freq AS (SELECT part, count(DISTINCT owner) AS owners, count(DISTINCT (owner, coalesce(doc_id::VARCHAR, '-'))) AS repositories FROM cands JOIN d USING (rid) GROUP BY part),
told AS (SELECT c.*, owners, repositories, owners >= {COPIED_OWNERS} OR repositories >= {COPIED_REPOSITORIES} AS copied FROM cands c JOIN freq f ON f.part = c.part),
judged AS (SELECT c.*, NOT copied AND {random_looking.format("c.part")} AS live FROM told c),
per AS (SELECT rid, count(*) FILTER (is_base AND kind = 'assign') AS n_assign, count(*) FILTER (is_base AND kind = 'access') AS n_access, count(*) FILTER (is_base AND kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (is_base), '') AS base,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (is_base OR live), '') AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied,
    string_agg(start || ':' || stop || ':' || owners || ':' || repositories, ',' ORDER BY start, stop, owners, repositories) AS held
  FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(held, '') AS held
FROM d LEFT JOIN per USING (rid)
"""
