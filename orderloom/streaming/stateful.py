"""Folds as streams: each key's rows in order of their time, however late within the watermark, from one micro-batch to the next.

A processor holds a key's rows back until the watermark has passed them, so that the rows of a time are complete, and
then gives them to the same step that the batch folds use. The step itself is the state: it is bounded by its own
parameters (entries of a cache, times of a limit), the rows held back by the watermark's delay. A key without rows for
its life is forgotten, state and all. Rows later than the watermark are dropped, as Spark does.

The state needs the RocksDB provider, and is restored from the query's checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderloom import lexicon as lx
from orderloom.streaming import sessions

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Gives a step each key's rows by time and then by the columns of order."""

    def __init__(self, key: str, ts: str, order: list[str], columns: list[str], start: Callable, life: float | None):
        self.key, self.ts, self.order, self.columns, self.start = key, ts, order, columns, start
        self.life = None if life is None else int(life * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, row binary")
        self.step = handle.getValueState("step", "step binary")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = []
        for batch in rows:
            at = (batch[self.ts].astype("datetime64[us]").astype("int64")).tolist()
            added += [(a, pickle.dumps(r)) for a, r in zip(at, batch[self.columns].itertuples(index=False, name=None))]
        if added:
            self.rows.appendList(added)
            self.handle.registerTimer(-(-min(a for a, _ in added) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.rows.get()) if self.rows.exists() else []
        ready, rest = [r for r in held if r[0] <= now * 1000], [r for r in held if r[0] > now * 1000]
        if rest:
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        if not ready:
            last = self.last.get()[0] if self.last.exists() else None
            if not rest and self.life is not None and last is not None and last + self.life <= now:
                for state in (self.rows, self.step, self.last):
                    state.clear()
            return
        step = pickle.loads(self.step.get()[0]) if self.step.exists() else self.start()
        # a state that ended before the next row is one that a batch run would not have either
        rows = pd.DataFrame([pickle.loads(r[1]) for r in ready], columns=self.columns).sort_values([self.ts, *self.order], kind="stable").reset_index(drop=True)
        found = step(rows)
        self.step.update((pickle.dumps(step),))
        at = max(r[0] for r in ready) // 1000
        self.last.update((at,))
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
            if self.life is not None:
                self.handle.registerTimer(at + self.life + 1)
        yield found

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, ts: str, order: list[str], start: Callable, schema: str, late: str, life: float | None = None) -> DataFrame:
    """What the step gives for each key's rows in order of ts and then order, as a stream; life: seconds after which an idle key is forgotten.

    life must not be shorter than what the step remembers, if the stream is to equal the batch.
    """
    processor = InOrder(key, ts, order, rows.columns, start, life)
    marked = rows.withWatermark(ts, late)
    return marked.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def sessionize(events: DataFrame, key: str, ts: str, order: str, gap: int = lx.SESSION_TTL, late: str = "1 hour") -> DataFrame:
    """events with session, the number of pauses over gap seconds before them."""
    fields = ", ".join(f"`{n}` {k}" for n, k in _kinds(events).items())
    return in_order(events, key, ts, [order], lambda: sessions.SessionStep(ts, gap), f"{fields}, session long", late)


def exact_cache(log: DataFrame, cache: str, order: str, ts: str, seconds: str, key: str, ttl: int = lx.CACHE_TTL, size: int = lx.CACHE_SIZE, late: str = "1 hour") -> DataFrame:
    """cache, order, hit and hits, as sessions.exact_cache gives them; a cache idle for the life of an entry is forgotten."""
    k = _kinds(log)
    start = lambda: sessions.ExactStep(cache, order, seconds, key, ttl, size)
    return in_order(log.select(cache, order, ts, seconds, key), cache, ts, [order], start, f"{cache} {k[cache]}, {order} {k[order]}, hit boolean, hits long", late, ttl + 1)


def semantic_cache(log: DataFrame, cache: str, order: str, ts: str, seconds: str, key: str, embedding: str, threshold: float = lx.SEMANTIC_DEFAULT, ttl: int = lx.CACHE_TTL, size: int = lx.CACHE_SIZE, late: str = "1 hour") -> DataFrame:
    """cache, order, hit, matched and similarity, as sessions.semantic_cache gives them."""
    k = _kinds(log)
    start = lambda: sessions.SemanticStep(cache, order, seconds, key, embedding, threshold, ttl, size)
    schema = f"{cache} {k[cache]}, {order} {k[order]}, hit boolean, matched {k[key]}, similarity double"
    return in_order(log.select(cache, order, ts, seconds, key, embedding), cache, ts, [order], start, schema, late, ttl + 1)
