"""Document fingerprints: bottom-k sketches of shingle hashes, from built-in functions only.

A sketch holds the K least hashes of a text's distinct shingles of five words (of fewer words: all of them as one). Hashes
are the first 16 hexadecimal digits of MD5, so they sort as texts and mean the same everywhere. The least hashes of two
sketches together are the sketch of both texts together, which gives their resemblance, containment and the number of
distinct shingles, and lets sketches of parts be merged without the parts.

Null and empty texts have no shingles and the empty sketch; two empty sketches resemble each other by 1. Repeated words
and rows change nothing. Texts of any length are hashed whole. Columns of the same names as those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.llm._shared import materialize, table, text_of
from orderloom.llm.spans import once

WORDS = 5
K = 128
DIGITS = 16
SPACE = r"[\x20\x09-\x0D]+"


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the text's shingles in order, repeats included."""

    def hashed(v: Column) -> Column:
        w = v["w"]
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
        at = lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(w, i + k) for k in range(words)])), 1, DIGITS)
        return F.when(F.size(w) > 0, F.transform(starts, at)).otherwise(F.array().cast("array<string>"))

    return once({"w": F.array_remove(F.split(text, SPACE), "")}, hashed)


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: str | Column, k: int = K, words: int = WORDS) -> Column:
    """The sketch of a text: at most k hashes, ascending."""
    return least(shingles(text_of(text), words), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketches' texts hold together."""
    return least(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles among all of both."""
    both = {"a": a, "b": b, "u": merged(a, b, k)}
    share = lambda v: F.size(F.array_intersect(v["u"], F.array_intersect(v["a"], v["b"]))) / F.size(v["u"])
    return once(both, lambda v: F.when(F.size(v["u"]) > 0, share(v)).otherwise(F.lit(1.0)))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: exact below k."""
    top = F.conv(F.substring(F.element_at(s, -1), 1, 13), 16, 10).cast("double") / float(16**13)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b holds too; 1 where a has none."""

    def share(v: Column) -> Column:
        common = resemblance(v["a"], v["b"], k) * distinct_shingles(v["u"], k)
        return F.when(F.size(v["a"]) > 0, F.least(F.lit(1.0), common / distinct_shingles(v["a"], k))).otherwise(F.lit(1.0))

    return once({"a": a, "b": b, "u": merged(a, b, k)}, share)


def with_sketch(df: DataFrame, text: str = "text", into: str = "sketch", k: int = K, words: int = WORDS) -> DataFrame:
    return df.withColumn(into, sketch(text, k, words))


def grouped(df: DataFrame, by: list[str], sketches: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of by, from the sketches of its rows. Each task keeps the k least hashes of a group before they are shuffled."""
    hashes = df.select(*by, F.explode(sketches).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_hash"))
    few = hashes.withColumn("_place", place).where(F.col("_place") <= k)
    return few.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(sketches))


def followers(keys: DataFrame, order: list[Column]) -> DataFrame:
    """keys (distinct rows) and next, the row after each in that order; after the last comes the first.

    Rows are dealt into ranges; within a range the next row follows, and a range's last row is followed by the first of the next range.
    Only the ranges' first rows, one each, meet in one task.
    """
    row = F.struct(*keys.columns)
    ranges = materialize(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("part").orderBy(*order)
    placed = ranges.select("part", *keys.columns, F.lead(row).over(within).alias("next"), F.row_number().over(within).alias("place"))
    heads = materialize(placed.where("place = 1").select("part", row.alias("head")), "range-heads")
    by_part = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part)).alias("after"))
    return placed.join(after, "part").select(*keys.columns, F.coalesce("next", "after").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited and next_sketch: the text with its last third replaced by the beginning of the next document, and that document's sketch.

    The next document has the next lower doc_id (null comes last, then the first again). Rows of one id follow each
    other by the hash of their texts; rows of one id and text are one document and get the same result.
    """
    own = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), text_of("text").alias("text"))
    own = own.withColumn("hash", F.xxhash64("text"))
    key = ["id", "none", "hash"]
    keys = own.select(*key, F.length("text").alias("size")).distinct()
    order = followers(keys, [F.col("none").asc(), F.col("id").desc(), F.col("hash").asc()])
    asked = order.select(*[F.col(f"next.{c}").alias(c) for c in key], F.struct(*key).alias("for"), F.floor(F.col("size") / 3).cast("int").alias("third"))
    lent = own.join(asked, key).select("for.*", F.substring("text", F.lit(1), F.col("third")).alias("lent"), F.array_join(sketch("text"), "").alias("next_sketch"), "third")
    lent = lent.repartition(*key).dropDuplicates(key)
    kept = F.substring("text", F.lit(1), F.length("text") - F.col("third"))
    found = own.join(lent, key)
    return found.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "text", F.concat(kept, F.col("lent")).alias("edited"), split_up("next_sketch").alias("next_sketch"))


def split_up(joined: str) -> Column:
    """The hashes of a sketch that was written as one text."""
    return F.regexp_extract_all(joined, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def op11_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("doc_id", "text", "edited", "next_sketch", sketch("text").alias("own"), sketch("edited").alias("other"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"), F.array_join("other", "").alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other")).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )


def _sql_sketch(text: str) -> str:
    words = f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    hashed = f"list_transform(range(1, greatest(len(ws) - {WORDS - 1}, least(len(ws), 1)) + 1), lambda i: left(md5(array_to_string(ws[i:i + {WORDS - 1}], ' ')), {DIGITS}))"
    return f"(SELECT list_sort(list_distinct({hashed}))[1:{K}] FROM (SELECT {words} AS ws))"


def _sql_near(a: str, b: str) -> str:
    union = f"list_sort(list_distinct({a} || {b}))[1:{K}]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({union}, list_intersect({a}, {b})))::DOUBLE / len({union}) END"


OP11_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, count(*) OVER () AS total FROM documents),
e AS (SELECT a.doc_id, a.t, b.t AS nt, left(a.t, length(a.t) - length(a.t) // 3) || left(b.t, length(a.t) // 3) AS edited FROM d a JOIN d b ON b.r = a.r % a.total + 1),
s AS (SELECT doc_id, t, edited, {_sql_sketch("t")} AS own, {_sql_sketch("edited")} AS other, {_sql_sketch("nt")} AS nxt FROM e)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
  {_sql_near("own", "other")} AS near_edited, {_sql_near("own", "nxt")} AS near_next FROM s
"""
