"""Rows in the order of a key, chained one to the next, in ranges of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range that one task sorts, on average.
IN_RANGE = 1_000_000


def chained(rows: DataFrame, key: str, group: list[str], into: str, in_range: int = IN_RANGE) -> DataFrame:
    """group, key and into, the next key of the group, null after its last; keys of a group are unique.

    Rows are dealt into ranges of the groups and keys together, so a group of any size is many ranges. Each range is chained on its own, and
    the last of each group in a range is linked to its first in the next one, by one row a group and range. The ranges are kept while they are read twice, so both
    readings agree.
    """
    narrow = rows.select(*group, key)
    parts = max(1, -(-narrow.count() // in_range))
    ranged = narrow.repartitionByRange(parts, *group, key).withColumn("_part", F.spark_partition_id()).persist()
    linked = ranged.withColumn(into, F.lead(key).over(Window.partitionBy(*group, "_part").orderBy(key)))
    ends = ranged.groupBy(*group, "_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    seams = ends.select(*group, F.col("_high").alias(key), F.lead("_low").over(Window.partitionBy(*group).orderBy("_part")).alias(into))
    inner = linked.where(F.col(into).isNotNull()).select(*group, key, into)
    return inner.unionByName(seams.select(*group, key, into))
