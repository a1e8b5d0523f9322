"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each merge rank has a bucket of linked-list positions; a two-level bitmap with
256-way fan-out marks the buckets that hold any. Find-first-set on each level
leads to the lowest rank, whose leftmost position is merged unless the entry is
stale (its pair has changed since it was queued). Queue operations cost a
constant number of word operations whatever the length of the pre-token, which
is what very long pre-tokens need.

Row-wise and without a shuffle. Long texts are encoded in slices cut before a
single space between two non-spaces, where no match of the splitting pattern can
continue. Null text is read as empty and gives no tokens. Every row keeps its own
result; other columns are untouched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import free_name, table, text_of
from orderloom.llm.letters import Splitter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SLICE = 1 << 20
CACHED_PIECES = 400_000
CACHED_LENGTH = 64


FAN = 8  # bits of a rank that the lower bitmap level takes: 256-way words


class RankQueue:
    """Buckets of positions by rank, under two levels of bitmaps."""

    __slots__ = ("top", "low", "buckets")

    def __init__(self):
        self.top = 0
        self.low: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        word = rank >> FAN
        self.low[word] = self.low.get(word, 0) | 1 << (rank & (1 << FAN) - 1)
        self.top |= 1 << word

    def pop(self) -> tuple[int, int]:
        """The lowest rank that has positions, with its leftmost one; the queue must not be empty."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        rank = word << FAN | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.top &= self.top - 1
        return rank, bucket[0]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: adjacent parts join in order of rank, leftmost first."""
    n = len(piece)
    ends = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))
    pair = [-1] * n  # the rank of the part that starts here with the next one
    queue, rank_of = RankQueue(), ranks.get
    push, pop = queue.push, queue.pop
    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            pair[i] = r
            push(r, i)
    while queue.top:
        rank, i = pop()
        if pair[i] != rank:
            continue
        j = ends[i]
        k = ends[i] = ends[j]
        pair[i] = pair[j] = -1
        if k < n:
            before[k] = i
            if (r := rank_of(piece[i : ends[k]])) is not None:
                pair[i] = r
                push(r, i)
        h = before[i]
        if h >= 0:
            r = rank_of(piece[h:k])
            pair[h] = -1 if r is None else r
            if r is not None:
                push(r, h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Codec(dict):
    """Pre-token to its ids as packed little-endian 32-bit integers, kept within a bound."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        lines = (line.split() for line in open(path, "rb"))
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pieces = Splitter(pattern)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            packed = array("I", [whole] if whole is not None else merge_bytes(raw, self.ranks)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:  # pieces in use move over from the older half
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        parts, at = [], 0
        while len(text) - at > SLICE:
            cut = self.cut.search(text, at + SLICE)
            if cut is None:
                break
            parts.append(b"".join(map(self.__getitem__, self.pieces(text[at : cut.start()]))))
            at = cut.start()
        parts.append(b"".join(map(self.__getitem__, self.pieces(text[at:]))))
        return b"".join(parts)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", packed)))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def with_encoding(df: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df and its text's ids, as array<int>; a column named into is replaced."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        c = codec(ranks, pattern)
        return pd.Series([array("i", c.encode(t)) for t in texts], dtype=object)

    return df.withColumn(into, encode(text_of(text)))


def with_decoding(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df and the bytes its ids stand for; null ids give no bytes, and a column named into is replaced."""

    @F.pandas_udf("binary")
    def decode(lists: pd.Series) -> pd.Series:
        c = codec(ranks, pattern)
        return pd.Series([c.decode(array("I", [] if x is None else list(x)).tobytes()) for x in lists], dtype=object)

    return df.withColumn(into, decode(ids))


def with_digests(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256: a round trip that ships digests, not ids. Columns of these names, in any case, are replaced."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(ranks, pattern), []
        for t in texts:
            ids = c.encode(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names, found = [c for c in df.columns if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256")], free_name(df, "_digest")
    return df.select(*names, digest(text_of(text)).alias(found)).select(*names, f"{found}.*")


def encode_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as p

    digests = with_digests(docs.select("doc_id", "text"), p.path(VOCABULARY), p.PATTERN)
    return digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
