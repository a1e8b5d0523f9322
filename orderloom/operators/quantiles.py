"""Order statistics of groups of any size without sorting a group.

A value at a rank is found by narrowing a bracket: each round looks only at the rows inside it, summarises them
(a mergeable sketch for numbers, counts by the next digits for digests), and counts exactly what lies below. When few
rows are left they are counted by value. Equal values are counted, never gathered, so a value that half of a group has
costs no more than others. What a task holds for a group is a sketch, or IN_HAND distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bracket that are counted by value in the end.
IN_HAND = 50_000
#: Steps of the sketch's grid, and its accuracy; the margin of a step on either side is far above its error.
GRID, ACCURACY = 100, 10_000
MAX_ROUNDS = 60
#: Digits of a digest that a round looks at.
DIGITS = 3


def _joined(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the state of their group; null is a group of its own."""
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    own = [F.col(f"r.{c}").alias(c) for c in rows.columns]
    more = [F.col(f"s.{c}").alias(c) for c in state.columns if c not in keys]
    r, s = rows.alias("r"), state.alias("s")
    return (r.join(s, on) if on else r.crossJoin(F.broadcast(s))).select(*own, *more)  # without keys the state is one row a name


def _ranks(wanted: dict[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in wanted.items()]))


def values_at(rows: DataFrame, value: str, wanted: dict[str, Column], *keys: str, in_hand: int = IN_HAND) -> DataFrame:
    """keys, and the value at each wanted rank (from 1, an expression of n, the group's number of values) under its name.

    Null values do not count; ranks outside 1 to n give null, and groups without values are not there.
    """
    keys = list(keys)
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    groups = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    state = groups.select(*keys, "n", "lo", "hi", _ranks(wanted).alias("w")).select(*keys, "w.*", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = state.where("rank BETWEEN 1 AND inside").persist()
    done = state.where(f"inside <= {in_hand} OR lo = hi")
    for _ in range(MAX_ROUNDS):
        wide = state.where(f"inside > {in_hand} AND lo < hi")
        if not wide.head(1):
            break
        inner = _joined(v, wide, keys).where("v BETWEEN lo AND hi")
        grid = inner.groupBy(*keys, "name").agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid"))
        at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * GRID).cast("int")
        edge = lambda i: F.element_at("grid", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)) + 1)
        near = _joined(wide, grid, [*keys, "name"]).select(*wide.columns, edge(at - 2).alias("_lo"), edge(at + 3).alias("_hi"))
        near = near.withColumns({"_lo": F.when(at <= 2, F.col("lo")).otherwise(F.col("_lo")), "_hi": F.when(at >= GRID - 3, F.col("hi")).otherwise(F.col("_hi"))})
        counted = _joined(v, near, keys).where("v BETWEEN lo AND hi").groupBy(*keys, "name", "rank", "lo", "hi", "below", "inside", "_lo", "_hi")
        counted = counted.agg(F.count_if(F.expr("v < _lo")).alias("under"), F.count_if(F.expr("v BETWEEN _lo AND _hi")).alias("within"))
        held = F.expr("rank > below + under AND rank <= below + under + within AND within < inside")
        # where the narrower bracket is as full as before, a middle value splits it
        after = counted.select(*keys, "name", "rank", *[F.when(held, F.expr(a)).otherwise(F.expr(b)).alias(c) for c, a, b in (("lo", "_lo", "lo"), ("hi", "_hi", "hi"), ("below", "below + under", "below"), ("inside", "within", "inside"))], held.alias("moved"))
        after = after.persist()
        if after.where("NOT moved").head(1):
            after = _halved(v, after, keys).persist()
        done = done.unionByName(after.drop("moved").where(f"inside <= {in_hand} OR lo = hi"))
        state = after.drop("moved")
    else:
        raise RuntimeError(f"brackets did not close in {MAX_ROUNDS} rounds")
    equal = done.where("lo = hi").select(*keys, "name", F.col("lo").alias("value"))
    few = _joined(v, done.where("lo < hi"), keys).where("v BETWEEN lo AND hi").groupBy(*keys, "name", "rank", "below", "v").agg(F.count("*").alias("c"))
    until = F.sum("c").over(Window.partitionBy(*keys, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = few.withColumn("until", F.col("below") + until).where("rank <= until AND rank > until - c").select(*keys, "name", F.col("v").alias("value"))
    named = equal.unionByName(found).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])
    return _joined(groups.select(*keys, "n"), named, keys) if keys else groups.select("n").crossJoin(named)


def _halved(v: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets that did not move are cut at the mean of their rows, the rest stays."""
    stuck = state.where("NOT moved").drop("moved")
    inner = _joined(v, stuck, keys).where("v BETWEEN lo AND hi")
    mean = inner.groupBy(*keys, "name").agg(F.avg("v").cast(v.schema["v"].dataType).alias("mid"))
    cut = _joined(stuck, mean, [*keys, "name"])
    both = _joined(v, cut, keys).where("v BETWEEN lo AND hi").groupBy(*cut.columns)
    both = both.agg(F.count_if(F.expr("v <= mid")).alias("left"), F.max(F.expr("CASE WHEN v <= mid THEN v END")).alias("last"), F.min(F.expr("CASE WHEN v > mid THEN v END")).alias("next"))
    low = F.expr("rank <= below + left")
    out = both.select(*keys, "name", "rank", *[F.when(low, F.expr(a)).otherwise(F.expr(b)).alias(c) for c, a, b in (("lo", "lo", "next"), ("hi", "last", "hi"), ("below", "below", "below + left"), ("inside", "left", "inside - left"))], F.lit(True).alias("moved"))
    return state.where("moved").unionByName(out)


def digests_at(rows: DataFrame, digest: str, tie: str, wanted: dict[str, Column], *keys: str, in_hand: int = IN_HAND) -> DataFrame:
    """keys, n, and (digest, tie) of the row at each wanted rank in order of digest and tie, null for ranks outside 1 to n. digest: hexadecimal text, all of one length."""
    keys = list(keys)
    v = rows.select(*keys, F.col(digest).alias("d"), F.col(tie).alias("t"))
    groups = v.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.length("d")).alias("size"))
    state = groups.select(*keys, "n", "size", _ranks(wanted).alias("w")).select(*keys, "w.*", "size", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = state.where("rank BETWEEN 1 AND inside").persist()
    done = state.where(f"inside <= {in_hand} OR length(prefix) >= size")
    while True:
        wide = state.where(f"inside > {in_hand} AND length(prefix) < size")
        if not wide.head(1):
            break
        inner = _joined(v, wide, keys).where(F.expr("startswith(d, prefix)"))
        by = inner.groupBy(*keys, "name", "rank", "size", "below", F.substring("d", F.lit(1), F.length("prefix") + DIGITS).alias("prefix")).agg(F.count("*").alias("inside"))
        until = F.sum("inside").over(Window.partitionBy(*keys, "name").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))  # 16 ** DIGITS rows a group
        state = by.withColumn("until", F.col("below") + until).where("rank <= until AND rank > until - inside").withColumn("below", F.expr("until - inside")).drop("until").select(*state.columns).persist()
        done = done.unionByName(state.where(f"inside <= {in_hand} OR length(prefix) >= size"))
    few = _joined(v, done, keys).where(F.expr("startswith(d, prefix)"))
    place = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("d", "t")) + F.col("below")
    found = few.withColumn("place", place).where("place = rank")
    named = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.struct(F.col("d").alias(digest), F.col("t").alias(tie)))).alias(n) for n in wanted])
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    g, m = groups.alias("g"), named.alias("m")
    return g.join(m, on, "left").select(*[F.col(f"g.{k}").alias(k) for k in keys], "g.n", *[F.col(f"m.{n}").alias(n) for n in wanted])
