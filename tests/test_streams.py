"""Streams of folds equal the batch folds over the same log: several micro-batches, late rows, a restart from the checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from orderloom.streaming import sessions, stateful

SCHEMA = "u long, n long, ts timestamp, seconds double, k string, e array<double>"


def log(n=240, seed=3):
    """Rows by arrival: times run ahead with pauses, and some rows come up to 20 minutes late."""
    rng, now, rows = random.Random(seed), 1_700_000_000.0, []
    for i in range(n):
        now += rng.choice([1.5, 30.25, 200.0, 4000.0 if rng.random() < 0.2 else 5.0])
        at = now - rng.choice([0, 0, 0, 400.125, 1200.0])
        rows.append((i % 3, i, at, rng.choice("abcdefg"), [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "u long, n long, seconds double, k string, e array<double>")
    return df.select("u", "n", F.timestamp_seconds("seconds").alias("ts"), "seconds", "k", "e")


def ahead(rows):
    """A row of a key of its own, late enough to move the watermark past all others, and one more to set off a last batch."""
    end = max(r[2] for r in rows) + 10_000_000
    return [[(99, 10_000, end, "a", [1.0, 0.0, 0.0])], [(99, 10_001, end + 1, "a", [1.0, 0.0, 0.0])]]


FOLDS = {
    "sessions": (
        lambda df: sessions.sessionize(df, "u", "ts", gap=1800).select("u", "n", "session"),
        lambda df: stateful.sessionize(df, "u", "ts", "n", gap=1800, late="30 minutes").select("u", "n", "session"),
    ),
    "exact": (
        lambda df: sessions.exact_cache(in_time(df), "u", "place", "seconds", "k", ttl=900, size=3).select("u", "place", "hit", "hits"),
        lambda df: stateful.exact_cache(df, "u", "n", "ts", "seconds", "k", ttl=900, size=3, late="30 minutes").select("u", "n", "hit", "hits"),
    ),
    "semantic": (
        lambda df: sessions.semantic_cache(in_time(df), "u", "place", "seconds", "k", "e", threshold=0.9, ttl=900, size=3).select("u", "place", "hit", "matched", "similarity"),
        lambda df: stateful.semantic_cache(df, "u", "n", "ts", "seconds", "k", "e", threshold=0.9, ttl=900, size=3, late="30 minutes").select("u", "n", "hit", "matched", "similarity"),
    ),
}


def in_time(df):
    """place: a number that orders by time, then by n, and holds n."""
    return df.withColumn("place", F.struct("seconds", "n"))


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_stream_equals_batch(spark, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    batch, stream = FOLDS[name]
    rows = log()
    late = (0, 5_000, min(r[2] for r in rows) - 5, "zz", [9.0, 9.0, 9.0])  # beyond the watermark when it comes
    parts = [rows[i : i + 48] for i in range(0, len(rows), 48)]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def put(part):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)

    def run():
        read = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream(read).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert not q.isActive and q.exception() is None
        return len([p for p in q.recentProgress if p.numInputRows])

    try:
        for part in parts[:3]:
            put(part)
        batches = run()
        for part in [parts[3] + [late], *parts[4:], *ahead(rows)]:  # a new query that goes on from the checkpoint
            put(part)
        batches += run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert batches >= 6
    got = sorted(str(tuple(r)) for r in spark.read.parquet(out).where("u < 99").collect())
    want = []
    for r in batch(frame(spark, rows)).collect():
        values = list(r)
        values[1] = values[1]["n"] if hasattr(values[1], "asDict") else values[1]
        want.append(str(tuple(values)))
    assert got == sorted(want) and len(want) == len(rows)


def test_idle_keys_are_forgotten():
    """Driven by hand: what a processor does with its states and timers when a key falls silent."""

    class Value:
        def __init__(self):
            self.held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Rows(Value):
        get = lambda self: iter(self.held or [])

        def appendList(self, rows):
            self.held = [*(self.held or []), *rows]

        put = Value.update

    class Handle:
        def __init__(self):
            self.timers, self.states = set(), {}

        def getListState(self, name, schema):
            return self.states.setdefault(name, Rows())

        def getValueState(self, name, schema):
            return self.states.setdefault(name, Value())

        registerTimer = lambda self, at: self.timers.add(at)

    class Times:
        def __init__(self, now):
            self.now = now

        getCurrentWatermarkInMs = lambda self: self.now

    import pandas as pd

    handle = Handle()
    p = stateful.InOrder("u", "ts", ["n"], ["u", "n", "ts"], lambda: sessions.SessionStep("ts", 60), 100)
    p.init(handle)
    rows = pd.DataFrame({"u": [1, 1], "n": [2, 1], "ts": pd.to_datetime([5_000, 1_000], unit="ms")})
    assert list(p.handleInputRows((1,), iter([rows]), Times(0))) == [] and handle.timers == {1_000}
    assert [f.n.tolist() for f in p.handleExpiredTimer((1,), Times(1_000), None)] == [[1]] and 5_000 in handle.timers
    assert [f.session.tolist() for f in p.handleExpiredTimer((1,), Times(6_000), None)] == [[0]] and 105_001 in handle.timers
    assert list(p.handleExpiredTimer((1,), Times(50_000), None)) == [] and handle.states["step"].exists()
    assert list(p.handleExpiredTimer((1,), Times(105_001), None)) == [] and not any(s.exists() for s in handle.states.values())
