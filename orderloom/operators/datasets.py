"""Datasets of exact make-up from candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.functions import text as tx


def shares_of(total: int, shares: dict[str, float]) -> dict[str, int]:
    """A total dealt by shares, rounded down, with what is left over for the first ones."""
    found = {k: int(total * s) for k, s in shares.items()}
    for k in list(found)[: total - sum(found.values())]:
        found[k] += 1
    return found


def quota_table(spark: SparkSession, quotas: dict[tuple[str, str], int]) -> DataFrame:
    """intent, language and quota."""
    each = F.array(*[F.struct(F.lit(i).alias("intent"), F.lit(lang).alias("language"), F.lit(n).cast("long").alias("quota")) for (i, lang), n in quotas.items()])
    return spark.range(1).select(F.inline(each))


def fill(candidates: DataFrame, quotas: DataFrame, order: Column) -> DataFrame:
    """sample_id, intent, language and text: of each intent and language as many as its quota, no two alike.

    candidates: id, intent, language and text, the order telling which come first. Texts that are alike but for case and blanks count
    once, for the candidate that comes first among all. The next ones in order take the place of duplicates. Where
    a quota is larger than what there is, candidates come again, with the number of the time behind their text.
    quotas: one row per intent and language; strata without candidates stay empty.
    """
    alike = F.lower(tx.strip(F.regexp_replace("text", r"\s+", " ")))
    ordered = candidates.withColumn("_order", F.struct(order, "id"))
    one = ordered.where("text IS NOT NULL").groupBy(alike.alias("_alike")).agg(F.min(F.struct("_order", "id", "intent", "language", "text")).alias("c")).select("c.*")
    asked = one.join(F.broadcast(quotas), ["intent", "language"])  # one row per stratum
    by_stratum = Window.partitionBy("intent", "language").orderBy("_order")
    most = quotas.agg(F.max("quota")).first()[0] or 0
    first = asked.withColumn("place", F.row_number().over(by_stratum)).where(F.col("place") <= most).where("place <= quota")
    sizes = first.groupBy("intent", "language").agg(F.count("*").alias("have"))
    again = first.join(sizes, ["intent", "language"])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("quota") - F.col("place")) / F.col("have")) + 1))
    again = again.withColumn("time", times)
    text = F.when(F.col("time") > 1, F.concat("text", F.lit(" #"), F.col("time"))).otherwise(F.col("text"))
    return again.select(F.col("id").alias("sample_id"), "intent", "language", text.alias("text"), F.col("time").cast("int").alias("time"))


def compact_messages(log: DataFrame, keys: list[str], session: str = "session") -> DataFrame:
    """The live messages of a log: keys, version and the rest, from rows of op append, update, delete (of a message) and drop (of its whole session).

    Of a message the row of the highest version counts, of equal versions the one written last (seq). A message that was
    never appended, or whose last row deletes it, is not there; a session's drop takes all that is no newer than it.
    """
    rest = [c for c in log.columns if c not in keys]
    dropped = log.where("op = 'drop'").groupBy(session).agg(F.max("version").alias("_gone"))
    own = log.where("op IN ('append', 'update', 'delete')").join(dropped, session, "left").where("_gone IS NULL OR version > _gone")
    at = F.struct("version", "seq")
    last = own.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_m"), F.max(F.col("op") == "append").alias("_is"))
    return last.where("_is AND _m.op <> 'delete'").select(*keys, "_m.*").drop("op")


def compact_log(log: DataFrame, keys: list[str], keep_from: int, session: str = "session") -> DataFrame:
    """The log without rows that no longer matter: one row for each live message and, from version keep_from on, for deletions and drops, so that writers that come late still meet them."""
    live = compact_messages(log, keys, session).withColumn("op", F.lit("append")).select(*log.columns)
    last = Window.partitionBy(*keys, "op").orderBy(F.desc("version"), F.desc("seq"))
    stones = log.where(F.col("op").isin("delete", "drop") & (F.col("version") >= keep_from)).withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
    return live.unionByName(stones)
