"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are dealt into equal ranges within
each source, as many as its documents need; sums by range and running sums over
ranges tell in which range the source's budget ends, and running sums inside
that one range give the key at which it is cut. Documents below the cut are taken
once more than the whole epochs that fit into the budget, the one at the cut for
the words left. So only narrow rows are shuffled, a source is sorted in ranges of
bounded length, and applying the mix to full documents needs no shuffle: each row
compares its key with its source's cut.

Null text has size 0 and is never taken; null sources form one source, ordered
last. Equal rows have equal keys and share what is left at a cut equally. Only
the named columns are read; the result of taken_words has its own columns and
mix_documents gives back the columns it got. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.llm._shared import WORD, materialize, table, text_of

WEIGHTS = (1, 2, 3)
EPOCHS = 3
ROWS_IN_RANGE = 2_000


def size_of(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def key_of(doc_id: str, text: str) -> Column:
    """60 bits that depend on the document alone."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), text_of(text)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def named(source: Column) -> Column:
    """A source's name that is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """name, source_size, docs and target for each source: one row per source comes in, and one goes out.

    Sources with the lowest ratio of size to weight reach their limit first; the
    first that does not sets the level at which all later ones share the rest.
    """
    by_name = Window.orderBy(F.col("name") == "-", "name")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("limit", epochs * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("name") == "-", "name")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("place", F.row_number().over(order))
        .withColumn("left", (F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double"))
        .withColumn("share", (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    )
    open_ = F.col("limit").cast("double") * F.col("share") > F.col("left") * F.col("weight")
    s = s.withColumn("first", F.min(F.when(open_, F.struct("place", "left", "share"))).over(all_))
    target = F.when(
        F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("limit").cast("double")
    ).otherwise(F.col("first.left") * F.col("weight") / F.col("first.share"))
    return s.select("name", "source_size", "docs", target.alias("target"))


def cuts(narrow: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """Per source: name, source_size, target, whole epochs, cut key and the words left for each row at the cut.

    narrow: name, key, size.
    """
    sizes = narrow.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    budget = F.floor("target").cast("long")
    plan = targets(sizes, weights, epochs).select(
        "name", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).cast("long").alias("rest"),
        F.ceil(F.col("docs") / rows_in_range).cast("long").alias("ranges"),
    )
    plan = materialize(plan, "mix-sources")
    part = F.shiftright(F.shiftright("key", 30) * F.col("ranges"), 30)
    dealt = by_source(narrow, plan.where("rest > 0").select("name", "rest", "ranges"), "inner").withColumn("part", part)
    running = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        dealt.groupBy("name", "rest", "part").agg(F.sum("size").alias("in_part"))
        .withColumn("end", F.sum("in_part").over(running))
        .where("end - in_part < rest and rest <= end")
        .select("name", "part", (F.col("end") - F.col("in_part")).alias("before"))
    )
    ends = materialize(ends, "mix-ranges")
    inside = by_source(dealt, ends.withColumnRenamed("part", "cut_part"), "inner").where("part = cut_part")
    equal = inside.groupBy("name", "rest", "before", "key").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    step = Window.partitionBy("name").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        equal.withColumn("end", F.col("before") + F.sum("words").over(step))
        .where("end - words < rest and rest <= end")
        .select("name", F.col("key").alias("cut"), F.expr("(rest - (end - words)) div rows").alias("at_cut"))
    )
    joined = plan.join(cut, "name", "left")
    return materialize(
        joined.select("name", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"), F.coalesce("at_cut", F.lit(0).cast("long")).alias("at_cut")),
        "mix-cuts",
    )


def by_source(rows: DataFrame, sources: DataFrame, how: str, salts: int = 16) -> DataFrame:
    """rows with their source's values. Spark broadcasts sources where its size allows; beyond that, salt spreads a hot source."""
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod("key", F.lit(salts))).join(salted, ["name", "salt"], how).drop("salt")


def taken() -> Column:
    """Words taken of a row with size and key, by its source's cut."""
    return (
        F.col("whole") * F.col("size")
        + F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.col("at_cut")).otherwise(0)
    ).cast("long")


def taken_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), named(F.col(source)).alias("name"), size_of(text).alias("size"), key_of(doc_id, text).alias("key")
    )
    narrow = materialize(narrow, "mix-rows")
    rows = by_source(narrow, cuts(narrow.select("name", "key", "size"), weights, epochs), "left")
    return rows.select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each document as often as it is taken.

    Documents are not split here; the one at a cut comes once more if at least
    half of it fits.
    """
    kept = [F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*kept).alias("doc"), named(F.col("source")).alias("name"), size_of("text").alias("size"), key_of("doc_id", "text").alias("key"))
    narrow = materialize(rows.select("name", "key", "size"), "mix-rows")
    found = by_source(rows, cuts(narrow, weights, epochs), "left")
    copies = F.when(F.col("size") > 0, F.floor((2 * taken() + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    return found.select("doc", F.explode(F.array_repeat(F.lit(1), copies))).select("doc.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS name,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT *, 3 * source_size AS lim,
    ((row_number() OVER (ORDER BY name = '-', name) - 1) % 3) + 1 AS w
  FROM (SELECT name, sum(size)::BIGINT AS source_size FROM d GROUP BY name)),
o AS (
  SELECT *, row_number() OVER q AS place,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lft,
    ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS share
  FROM s WINDOW q AS (ORDER BY lim::DOUBLE / w, name = '-', name)),
f AS (SELECT place AS fp, lft AS fl, share AS fs FROM o WHERE lim::DOUBLE * share > lft * w ORDER BY place LIMIT 1),
t AS (
  SELECT name, source_size, CASE WHEN fp IS NULL OR place < fp THEN lim::DOUBLE ELSE fl * w / fs END AS target
  FROM o LEFT JOIN f ON true),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM t),
g AS (
  SELECT name, k, sum(words) OVER (PARTITION BY name ORDER BY k ROWS UNBOUNDED PRECEDING) AS e, words, n
  FROM (SELECT name, k, sum(size)::BIGINT AS words, count(*) AS n FROM d GROUP BY name, k))
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN e <= rest THEN size WHEN e - words < rest THEN (rest - (e - words)) // n ELSE 0 END)::BIGINT AS taken
FROM d JOIN b USING (name) JOIN g USING (name, k)
"""
