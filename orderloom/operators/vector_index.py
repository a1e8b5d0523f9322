"""Stored inverted cells for vector search.

Centroids are trained on a bounded sample (SAMPLE rows, drawn by the hash of their ids, so that reruns agree); every
row is assigned to its nearest centroid. A query is compared with the rows of its nearest cells only. Cells and the
queries that probe them are dealt into blocks of bounded size, so a cell that holds a third of all rows is many tasks. How many cells
are probed is measured on the sample: as many as hold TARGET of the nearest rows of some of its own. A
query that finds too few rows in its cells is compared with all rows, as retrieval.vector_hits does.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.operators import retrieval

#: Rows that centroids are trained on, rounds of training, and centroids at most: what the driver holds.
SAMPLE, ROUNDS, MAX_CELLS = 20_000, 12, 4_096
BLOCK = 8_192
#: Share of the nearest rows that the probed cells are to hold, and rows of the sample on which, and for how many nearest ones, this is measured.
TARGET, MEASURED = 0.95, 256


class Index(NamedTuple):
    centroids: np.ndarray
    probes: int
    nodes: DataFrame  # with cell, null for rows without a vector of the centroids' length


def units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def nearest_of(points: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each point, a bounded number of cosines at a time."""
    return np.concatenate([(points[part] @ found.T).argmax(axis=1) for part in retrieval.slices(len(points), len(found))])


def train(nodes: DataFrame, key: str, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS, target: float = TARGET) -> tuple[np.ndarray, int]:
    """Centroids of unit vectors, by k-means on the sample, and how many cells to probe; vectors of the commonest length count."""
    drawn = nodes.where("size(embedding) > 0").select(key, "embedding").orderBy(F.xxhash64(key), key).limit(sample).collect()
    sizes = [len(r.embedding) for r in drawn]
    if not sizes:
        return np.zeros((0, 0)), 1
    dim = max(sorted(set(sizes)), key=sizes.count)
    points = units(np.array([r.embedding for r in drawn if len(r.embedding) == dim], dtype=np.float64))
    found = points[: min(cells, MAX_CELLS, len(points))].copy()
    for _ in range(rounds):
        own = nearest_of(points, found)
        for cell in range(len(found)):
            if (own == cell).any():
                found[cell] = points[own == cell].mean(axis=0)
        found = units(found)
    asked, own = points[:MEASURED], nearest_of(points, found)
    nearest = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, : lx.POOL]
    place = np.argsort(np.argsort(-(asked @ found.T), axis=1, kind="stable"), axis=1)
    places = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    return found, int(places[int(np.ceil(target * len(places))) - 1]) + 1


def nearest_cells(embedding: Column, centroids: np.ndarray, n: int) -> Column:
    """The n nearest centroids' numbers, the nearest first; null for a vector of another length or of none."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        good = [i for i, v in enumerate(vectors) if v is not None and centroids.size and len(v) == centroids.shape[1] and np.any(v)]
        for part in retrieval.slices(len(good), len(centroids)):
            near = np.round(np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in good[part]]) @ centroids.T, 9)
            for i, row in zip(good[part], np.argsort(-near, axis=1, kind="stable")[:, :n]):
                out.iloc[i] = row.astype(np.int32).tolist()
        return out

    return cells(embedding)


def build(nodes: DataFrame, key: str = "source_id", cells: int | None = None, sample: int = SAMPLE) -> Index:
    """nodes with their cell; cells: a number of them, by default the square root of the rows' number."""
    cells = cells or max(1, round(nodes.count() ** 0.5))
    centroids, probes = train(nodes, key, cells, sample)
    return Index(centroids, probes, nodes.withColumn("cell", nearest_cells(F.col("embedding"), centroids, 1)[0]))


def stored(index: Index) -> DataFrame:
    """The nodes in order of their cells, to be written: a search for some cells then reads those row groups only."""
    return index.nodes.repartitionByRange("cell").sortWithinPartitions("cell")


def search(queries: DataFrame, index: Index, k: int = lx.POOL, probes: int | None = None, least: float | None = lx.MIN_COSINE, exact_below: int = 1, block: int = BLOCK) -> DataFrame:
    """query_id, intent, source_id, source_type, text and score, as retrieval.vector_hits gives them, from the nearest cells, as many as the index says or probes.

    Queries with fewer than exact_below hits there, and those of another length of vector, get the exact search.
    """
    vector = queries.select("query_id", "intent", "embedding")
    probing = vector.withColumn("cell", F.explode(nearest_cells(F.col("embedding"), index.centroids, probes or index.probes)))
    rows = index.nodes.where("cell IS NOT NULL").select("source_id", "source_type", "embedding", "cell")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    n = blocks(rows, "n_n").join(blocks(probing, "n_q"), "cell")  # one row per cell
    dealt = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  both sides may come from one table
    q = probing.join(n, "cell").select(*own("query_id", "intent", "embedding", "cell"), dealt("query_id", "n_q").alias("qb"), every("n_n").alias("nb"))
    r = rows.join(n, "cell").select(*own("source_id", "source_type", "embedding", "cell"), every("n_q").alias("qb"), dealt("source_id", "n_n").alias("nb"))
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query_id", queries), ("source_id", index.nodes))]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return retrieval.nearest_in_blocks(a, b, k, least)

    found = q.groupBy("cell", "qb", "nb").cogroup(r.groupBy("cell", "qb", "nb")).applyInArrow(meet, ", ".join([*kinds, "score double"]))
    found = found.join(queries.select("query_id", "intent"), "query_id").join(index.nodes.select("source_id", "source_type", "text"), "source_id")
    found = retrieval.top(found.select("query_id", "intent", "source_id", "source_type", "text", "score"), k, within=("query_id", "source_type"))
    enough = found.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= exact_below).select("query_id")
    rest = queries.join(enough, "query_id", "left_anti")
    exact = retrieval.vector_hits(rest, index.nodes, k, least)
    return found.join(enough, "query_id", "left_semi").unionByName(exact)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted and found: how many of the exact hits the search has."""
    both = exact.select("query_id", "source_id").join(found.select("query_id", "source_id", F.lit(1).alias("_hit")), ["query_id", "source_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("found"))
