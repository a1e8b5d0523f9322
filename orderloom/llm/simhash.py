"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits from the XXH64 values of its three-word
shingles. Two fingerprints within three bits differ in at most three of their
eight bytes, so they share at least five bytes by position: the guaranteed
minimum. Postings are byte values by position. A posting of one byte would hold a 256th of
the corpus and more, so the index is keyed by three postings at once: any five of
eight positions hold three of the first four or three of the last four, eight
triples in all, and a pair with five shared postings meets under one of them with a
tally of three. Inside such a list the postings of the other five positions are
walked: every two entries of a posting get one more on their tally, so pairs come
from postings alone. Pairs whose tally reaches five are kept and verified bit by bit.

Documents with equal fingerprints are one entry of the index. Posting lists of
one entry are dropped before any pairing. Longer ones are dealt into blocks of
bounded size, and pairs of blocks are compared in tasks of their own, so that no
list is ever gathered in one place whatever its length. What a task emits for a
list is a forest that connects what the links connect, never all pairs.
Components of those forests are the components of all links.

Null and empty texts have fingerprint zero, linked like any other. A document
without an id belongs to its component but does not name it. Repeated rows
share a fingerprint. An empty table has no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import each, free_name, materialize, table, text_of
from orderloom.llm.components import SALTS, components

SHINGLE = 3
SEED = 42
BITS = 3
BYTES_SHARED = 8 - BITS
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7))
#: For each triple, the other five positions.
OTHERS = np.array([[p for p in range(8) if p not in t] for t in TRIPLES])
#: Fingerprints of a list in a block; a task pairs two blocks at most. Shared postings that a task tallies at a time.
BLOCK, PAIRS = 1024, 1 << 19
STEP = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + STEP))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """df and the fingerprint of its text column, as a signed 64-bit integer; a column named into is replaced."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return df.withColumn(into, fingerprints(text_of(text)))


def postings(fps: np.ndarray, lists: np.ndarray, key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the five positions outside an entry's triple: entries in order of their postings, each entry's place there, and how many follow it in its posting."""
    n = len(fps)
    parts, others = fps.view(np.uint8).reshape(n, 8), OTHERS[key >> 24]  # column i is byte i from the lowest
    found = []
    for column in range(others.shape[1]):
        posting = lists * 256 + parts[np.arange(n), others[:, column]]
        order = np.argsort(posting, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        found.append((order, place, np.searchsorted(posting[order], posting, "right") - place - 1))
    return found


def forest(fps: np.ndarray, lists: np.ndarray, key: np.ndarray, on_tally=None) -> np.ndarray:
    """Pairs of indices that connect, within each list, what links of BITS or fewer bits connect.

    lists numbers the lists; key names each entry's triple, three shared postings. The other five are tallied here, for
    so many entries at a time that their postings give PAIRS pairs; pairs that are connected by then are not tallied.
    """
    n = len(fps)
    index, parent, first = postings(fps, lists, key), np.arange(n), 0
    ends = np.cumsum(sum(follow for _, _, follow in index))
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        shared = []
        for order, place, follow in index:
            i, j = np.repeat(np.arange(first, last), follow[first:last]), order[each(place[first:last] + 1, follow[first:last])]
            apart = parent[i] != parent[j]
            shared.append(i[apart] * n + j[apart])
        pairs, tally = np.unique(np.concatenate(shared), return_counts=True)
        pairs = pairs[tally + 3 >= BYTES_SHARED]
        if on_tally is not None:
            on_tally(pairs)
        i, j = pairs // n, pairs % n
        near = np.bitwise_count(fps[i] ^ fps[j]) <= BITS
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        while near.any() and not np.array_equal(parent, up := parent[parent]):
            parent = up
        first = last
    child = np.flatnonzero(parent != np.arange(n))
    return np.stack([child, parent[child]], axis=1)


def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forests of posting lists, which arrive sorted by key and blocks; a list is held back until its end has come."""
    held = None

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        lists = rows.groupby(["key", "low", "high"], sort=False).ngroup().to_numpy()
        found = forest(np.ascontiguousarray(fps), lists, rows["key"].to_numpy(dtype=np.int64))
        ids = fps.view(np.int64)
        return pd.DataFrame({"u": ids[found[:, 0]], "v": ids[found[:, 1]]})

    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        whole = ~((rows["key"] == last["key"]) & (rows["low"] == last["low"]) & (rows["high"] == last["high"])).to_numpy()
        held = rows[~whole].reset_index(drop=True)
        if whole.any():
            yield linked(rows[whole].reset_index(drop=True))
    if held is not None and len(held):
        yield linked(held)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: links that connect the distinct fingerprints (column fp) as all pairs within BITS bits would."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    key = lambda t, p: F.lit(t << 24).cast("long") + byte(p[0]) * 65536 + byte(p[1]) * 256 + byte(p[2])
    postings = fps.select("fp", F.explode(F.array(*[key(t, p) for t, p in enumerate(TRIPLES)])).alias("key"))
    several = materialize(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "posting-lists")
    blocks = F.ceil(F.col("n") / block).cast("long")
    dealt = postings.join(several, "key").select("key", "fp", F.pmod(F.xxhash64("fp"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    pairs = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return pairs.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInPandas(forests, "u long, v long")


def with_root(rows: DataFrame) -> DataFrame:
    """rows (with fp, read more than once) and root, the least fingerprint that links reach."""
    fps = materialize(rows.select("fp").distinct(), "fingerprints")
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    labels = materialize(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    return rows.join(labels, "fp")


def with_component(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows (with doc_id and fp, read more than once) and component_id, the least doc_id that links reach."""
    first = rows.groupBy("fp").agg(F.min(doc_id).alias("first"))
    named = materialize(with_root(materialize(first, "fingerprint-ids")), "fingerprint-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = named.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    labels = materialize(named.join(least, ["root", "salt"]).select("fp", "component_id"), "components")
    return rows.join(labels, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least id, rows without an id last, and of rows with that id any one.

    Rows are told apart by a key of their own, written once with them, so neither equal ids nor equal rows matter.
    What is decided travels in narrow rows; the documents are read once more and shuffled once, unsorted, for a semi-join
    with the kept keys, in the same way at every size.
    """
    own, row = [F.col(c) for c in docs.columns], free_name(docs, "_row")
    keyed = materialize(docs.select(*own, F.monotonically_increasing_id().alias(row)), "keyed")
    narrow = materialize(with_fingerprint(keyed.select(F.col(row).alias("row"), "doc_id", "text"), "text").select("row", "doc_id", "fp"), "simhash")
    first = narrow.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    rooted = with_root(materialize(first, "fingerprint-rows"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(materialize(kept, "kept-rows").hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = materialize(with_fingerprint(docs).select("doc_id", "fp"), "simhash")
    return with_component(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
