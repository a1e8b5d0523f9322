"""Evaluation, benchmark and dataset-quality aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import text as tx
from orderloom.operators import quantiles


def ratio(n: Column, d: Column) -> Column:
    return F.round(n / F.greatest(F.lit(1), d), 4)


def classification(rows: DataFrame, labels: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """label, tp, fp, fn, support, precision, recall and f1, from one pass over the rows."""
    cells = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    per = cells.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), truth, guess, "n").groupBy("label").agg(
        *[
            F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
            for name, c in {
                "tp": (F.col(truth) == F.col("label")) & (F.col(guess) == F.col("label")),
                "fp": (F.col(truth) != F.col("label")) & (F.col(guess) == F.col("label")),
                "fn": (F.col(truth) == F.col("label")) & (F.col(guess) != F.col("label")),
            }.items()
        ]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return per.select("label", "tp", "fp", "fn", (tp + fn).alias("support"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def confusion(rows: DataFrame, labels: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """A row per true label, a column per guess, and parse_error for guesses that are no label; zeros filled in."""
    told = F.when(F.col(guess).isin(labels), F.col(guess)).otherwise("parse_error")
    return rows.withColumn("_told", told).groupBy(truth).pivot("_told", [*labels, "parse_error"]).count().na.fill(0)


def nearest_rank(values: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """The value at index round((n-1)*p), halves to even, of each group's values in order."""
    return quantiles.values_at(values, value, {"percentile": F.bround((F.col("n") - 1) * p) + 1}, *keys).select(*keys, "percentile")


def exclusive_quantile(values: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """The quantile at position p*(n+1) of each group's values in order, interpolated, held within them."""
    n = F.col("n")
    at = F.least(F.greatest(F.floor(n * p + p), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    found = quantiles.values_at(values.select(*keys, F.col(value).cast("double").alias("v")), "v", {"low": at, "high": F.least(at + 1, n)}, *keys)
    share = F.when(n > 1, (n + 1) * p - at).otherwise(0.0)
    return found.select(*keys, (F.col("low") * (1 - share) + F.col("high") * share).alias("quantile"))


def latency(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, n, mean, median, least and most of the values that are not null."""
    v, n = F.col(value), F.col("n")
    middle = quantiles.values_at(values, value, {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1}, *keys)
    middle = middle.select(*keys, F.round((F.col("low") + F.col("high")) / 2, 4).alias("median"))
    told = values.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys] or F.lit(True)
    both = told.alias("t").join(middle.alias("m"), on, "left")
    return both.select(*[F.col(f"t.{k}").alias(k) for k in keys], "t.n", "t.mean", "m.median", "t.least", "t.most")


def cache_rollup(log: DataFrame) -> DataFrame:
    """Hit rates of a request log (intent, cacheable, hit, latency) and the gates they must pass."""
    n, hit = F.count("*"), F.count_if("hit")
    row = log.agg(
        n.alias("requests"), ratio(hit, n).alias("hit_rate"),
        ratio(F.count_if(F.col("hit") & F.col("cacheable")), F.count_if("cacheable")).alias("cacheable_hit_rate"),
        ratio(F.count_if(F.col("hit") & (F.col("intent") == "order")), F.count_if(F.col("intent") == "order")).alias("false_hit_rate"),
    )
    return row.withColumn("passed", (F.col("cacheable_hit_rate") >= 0.60) & (F.col("false_hit_rate") == 0))


def split(rows: DataFrame, stratum: str, digest: Column, tie: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """rows with split: of each stratum in order of a hexadecimal digest and what tells ties apart, floor(n*train) train, floor(n*validation) validation, the rest test.

    Only the two rows at the cuts are looked for, one pair a stratum; rows are compared with those, and not sorted.
    """
    n = F.col("n")
    cuts = {"_train": F.floor(n * train), "_validation": F.floor(n * train) + F.floor(n * validation)}
    dealt = rows.withColumn("_digest", digest)
    found = quantiles.digests_at(dealt, "_digest", tie, cuts, stratum)
    met = dealt.alias("d").join(found.drop("n").withColumnRenamed(stratum, "_stratum").alias("c"), F.col(f"d.{stratum}").eqNullSafe(F.col("c._stratum")))
    own = F.struct(F.col("d._digest").alias("_digest"), F.col(f"d.{tie}").alias(tie))
    before = lambda cut: F.coalesce(own <= F.col(f"c.{cut}"), F.lit(False))
    split_ = F.when(before("_train"), "train").when(before("_validation"), "validation").otherwise("test")
    return met.select(*[F.col(f"d.{c}").alias(c) for c in rows.columns if c != "split"], split_.alias("split"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: how many rows break each rule, from one pass."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(r) for r in rules]))).alias("rule", "violations"))


def same_text(c: Column) -> Column:
    """A field's value as it is compared: trimmed, lower-case, without a number behind a mark, single blanks; empty for none."""
    low = F.regexp_replace(F.lower(tx.strip(c.cast("string"))), r"\s+#\d+$", "")
    return F.coalesce(tx.strip(F.regexp_replace(low, r"\s+", " ")), F.lit(""))


def field_matches(rows: DataFrame, fields: list[str], relevant: list[str], valid: dict[str, list[str]], raw: str = "raw", hard: str = "hard") -> DataFrame:
    """slice, metric, n and value of structured predictions, from one pass over the rows.

    raw holds a prediction as text, want_f the value wanted of each field f, hard a flag. A prediction parses if an object is found
    in it, and is valid if it has all fields as keys and allowed values (valid); only valid ones match. Rates are
    of all rows of their slice: all, and hard. A slice without rows has rates of 0. relevant: the fields that a cache depends on.
    """
    found = rows.withColumn("_object", tx.json_object(F.col(raw)))
    value = lambda f: F.get_json_object("_object", f"$.{f}")
    parsed = F.col("_object").isNotNull()
    keys = F.size(F.array_except(F.array(*map(F.lit, fields)), F.json_object_keys("_object"))) == 0
    good = parsed & F.coalesce(keys, F.lit(False))
    for f, values in valid.items():
        good = good & F.coalesce(value(f).isin(values), F.lit(False))
    found = found.withColumn("_valid", good)
    match = {f: F.col("_valid") & (same_text(value(f)) == same_text(F.col(f"want_{f}"))) for f in fields}
    every = lambda names: F.array_min(F.array(*[match[f] for f in names]))
    rates = {"parse_rate": parsed, "valid_rate": F.col("_valid"), "all_fields": every(fields), "cache_relevant": every(relevant)} | {f"field_{f}": c for f, c in match.items()}
    told = found.select(F.coalesce(hard, F.lit(False)).alias("hard"), *[c.alias(k) for k, c in rates.items()])
    counts = told.agg(*[F.count_if(F.col(k) & (F.lit(True) if s == "all" else F.col("hard"))).alias(f"{s}:{k}") for s in ("all", "hard") for k in rates], F.count("*").alias("all"), F.count_if("hard").alias("hard"))
    each = [
        F.struct(F.lit(s).alias("slice"), F.lit(k).alias("metric"), F.col(s).alias("n"), F.round(F.col(f"`{s}:{k}`") / F.greatest(F.lit(1), F.col(s)), 4).alias("value"))
        for s in ("all", "hard") for k in rates
    ]
    return counts.select(F.inline(F.array(*each)))
