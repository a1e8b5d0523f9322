"""The event stream of an answer: metadata, tokens and clauses in one order, errors, the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx

STREAM_ERROR = "Stream error, using fallback"
DONE = "[DONE]"
LAST = 2**31 - 1


def answer_events(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (from 0), event and data: what a client gets for each answer.

    answers: keys, text, started and first_at (seconds) and fails_at, the number of tokens after which the model fails, null
    for none. Tokens are words and a blank. A clause follows the token in which its mark stands, found by the
    number of blanks before it; one that is too short is left out; what remains without a mark follows the last
    token. METADATA, with the time to the first token in ms, comes before that token, so an answer without tokens has none. ERROR stands
    where the tokens end, DONE at the end. Null text is empty.
    """
    told = F.slice(tx.tokens(F.coalesce("text", F.lit(""))), F.lit(1), F.coalesce("fails_at", F.lit(LAST)).cast("int"))
    a = answers.select(*keys, "started", "first_at", "fails_at", told.alias("words"))
    event = lambda df, place, kind, sub, name, data: df.select(*keys, place.cast("int").alias("place"), F.lit(kind).alias("kind"), sub.cast("int").alias("sub"), F.lit(name).alias("event"), data.cast("string").alias("data"))
    zero, end = F.lit(0), F.lit(LAST)
    tokens = a.select(*keys, F.posexplode("words").alias("place", "word"))
    marks = lx.CLAUSE_MARKS.removesuffix("+")
    whole = F.concat(F.array_join("words", " "), F.lit(" "))
    parts = a.where(F.size("words") > 0).select(*keys, F.size("words").alias("size"), F.posexplode(F.split(whole, f"(?<={marks})(?!{marks})")).alias("sub", "part"))
    until = Window.partitionBy(*keys).orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("sub") == F.max("sub").over(Window.partitionBy(*keys))
    parts = parts.select("*", F.sum(F.length("part") - F.length(F.replace("part", F.lit(" ")))).over(until).alias("blanks"), last.alias("open"), tx.strip(F.col("part")).alias("clause"))
    long_enough = F.when(F.col("open"), F.col("clause") != "").otherwise(F.length("clause") >= lx.CLAUSE_MIN)
    parts = parts.where(long_enough).withColumn("place", F.when(F.col("open"), F.col("size")).otherwise(F.col("blanks")))
    ttft = F.round((F.col("first_at") - F.col("started")) * 1000, 2)
    all_ = [
        event(a.where(F.size("words") > 0), F.lit(-1), 0, zero, "METADATA", ttft), event(tokens, F.col("place"), 1, zero, "TOKEN", F.concat("word", F.lit(" "))),
        event(parts.where("NOT open"), F.col("place"), 2, F.col("sub"), "CLAUSE", F.col("clause")), event(a.where("fails_at IS NOT NULL"), F.size("words"), 3, zero, "ERROR", F.lit(STREAM_ERROR)),
        event(parts.where("open"), F.col("place"), 4, F.col("sub"), "CLAUSE", F.col("clause")), event(a, end, 5, zero, "DONE", F.lit(DONE)),
    ]
    found = all_[0]
    for more in all_[1:]:
        found = found.unionByName(more)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("place", "kind", "sub")) - 1
    return found.select(*keys, n.alias("n"), "event", "data")
