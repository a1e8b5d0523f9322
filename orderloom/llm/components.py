"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm._shared import materialize, remove

SALTS = 8
MAX_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """u and low, the least of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def _joined(pairs: DataFrame) -> DataFrame:
    """pairs with u's low; a hub's pairs are spread over salts, and its low is sent to each."""
    low = _lowest(pairs).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(low, ["u", "salt"])


def _links(df: DataFrame) -> DataFrame:
    return df.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, its component's least node, for every node of links (columns u and v, longs).

    Each round links every node to the least one it knows of: first its larger
    neighbours (large star), then its smaller ones (small star). Rounds end when
    the links, by then stars around the roots, no longer change; their number
    grows with the logarithm of the longest chain. Rounds are written to the
    shared folder, so lineage stays short.
    """
    spark = links.sparkSession
    now, seen = materialize(_links(links.select("u", "v")), "links"), None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64(F.least("u", "v"), F.greatest("u", "v")))).first()
        if state == seen:
            break
        seen = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_links(_joined(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))), "large-stars")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _joined(down).select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        after = materialize(_links(small), "small-stars")
        remove(spark, large)
        remove(spark, now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
