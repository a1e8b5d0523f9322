"""Which texts hold which of many needles, without comparing every text with every needle.

A text that holds a needle holds all its runs of GRAM characters. Texts list those of
their runs that some needle asks for, counts over all texts pick each needle's rarest run, and an
equi-join on that run gives candidates, which contains() then checks. Needles
shorter than GRAM are listed under themselves; the empty one is held by every text and joined without runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Asked runs that are sent to every task, so that other runs are never shuffled; more are joined as Spark sees fit.
BROADCAST_RUNS = 200_000


def runs(text: Column, size: int) -> Column:
    """Distinct runs of so many characters, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def holding(texts: DataFrame, key: str, fields: str, needles: DataFrame, needle: str) -> DataFrame:
    """key and needle for each text (a unique key, and fields, an array of strings) one of whose fields holds the needle.

    Nulls among fields and needles hold nothing and are held by nothing; repeated needles count once.
    """
    asked = needles.where(F.col(needle).isNotNull()).select(needle).distinct()
    sizes = range(1, GRAM + 1)
    own = F.least(F.lit(GRAM), F.char_length(needle))
    listed_runs = F.array().cast("array<string>")
    for size in sizes:
        listed_runs = F.when(own == size, runs(F.col(needle), size)).otherwise(listed_runs)
    parts = asked.select(needle, F.explode(listed_runs).alias("run"))
    wanted = parts.select("run").distinct()
    told = wanted.agg(F.count("*"), *[F.max(F.char_length("run") == size) for size in sizes]).first()
    n_asked = asked.count()
    used = [size for size, there in zip(sizes, told[1:]) if there]
    given = F.filter(fields, lambda f: f.isNotNull())
    each = F.flatten(F.transform(given, lambda f: F.concat(F.array().cast("array<string>"), *[runs(f, n) for n in used])))
    few = told[0] <= BROADCAST_RUNS
    listed = texts.select(key, F.explode(F.array_distinct(each)).alias("run")).join(F.broadcast(wanted) if few else wanted, "run", "left_semi")
    counts = listed.groupBy("run").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("run").alias("run")))
    index = parts.join(counts, "run", "left").groupBy(needle).agg(rarest.alias("r")).select(needle, F.col("r.run").alias("run"))
    holds = F.expr(f"exists(_given, f -> contains(f, `{needle}`))")
    if few and n_asked <= BROADCAST_RUNS:  # each text is checked where it is read
        near = texts.select(key, given.alias("_given"), F.explode(F.array_distinct(each)).alias("run")).join(F.broadcast(index), "run")
    else:
        near = listed.join(index, "run").select(key, needle).join(texts.select(key, given.alias("_given")), key)
    found = near.where(holds).select(key, needle)
    empty = F.broadcast(asked.where(F.col(needle) == ""))  # one row at most
    return found.unionByName(texts.where(F.size(given) > 0).select(key).join(empty, F.lit(True)))
