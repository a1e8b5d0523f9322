"""Chroma audio fingerprints of a media column, and the alignment of recordings by them.

A recording's frames are folded into twelve pitch classes. Sixteen filters, sums
and differences of areas taken from an integral image of those frames, are each
quantised to two bits in Gray code and packed into one 32-bit integer per frame.
Two recordings align at the offset that most of their equal integers agree on,
if the bit errors over the overlap are few.

Recordings with equal integers are one class; those too short for any integer are one
class where their bytes are equal. Groups are the components of alignments between
classes, found in two passes. The first is a shortcut over all recordings: each class
is listed under a few landmarks, its integers of least hash, and in each landmark's
list it meets the first and the last class only, provided that integers around the
landmark agree. That joins most copies at a cost in proportion to the classes, but
may miss some. The second pass is a search and exact: the stated queries, by default
every recording, are aligned with all recordings. Queries and recordings are cut into
blocks of bounded size, each pair of blocks is one task, and all recordings meet each
block of queries, so what is shuffled is the recordings once for each such block.
Where every recording is a query, the first pass would find nothing that the second
does not, and is left out; two blocks then meet once, not in either order. A
task tallies offsets of equal integers for each pair, checks the bits at the offset
with most, and gives back a forest of groups, never pairs.

So a group holds every alignment in which a query takes part, and of the others
those that landmarks lead to. Work grows with queries times recordings, as equal
integers arise by chance; a set of queries in proportion to the corpus therefore
costs the square of its size, a fixed set does not.

Null media have no frames and form groups of their own; empty ones are equal to each
other. Repeated rows are one class. A row without an id belongs to its group but does
not name it, unless no row of the group has one: then a hash does. Other columns are
untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import each, free_name, materialize, table
from orderloom.llm.components import components

CLASSES = 12
WIDTH = 16
LANDMARKS = 32
#: Frames around a landmark that must agree before two recordings are compared, and the share of their bits that may differ.
AROUND, MAX_LOCAL_ERROR = (-16, -8, -4, -2, 2, 4, 8, 16), 0.18
MAX_BIT_ERROR = 0.15
MIN_OVERLAP = 8
#: Integers in a block of queries or of recordings, and blocks that recordings make at least: those that queries meet, and those that all meet.
BLOCK_CODES, MIN_BLOCKS, MIN_WHOLE_BLOCKS = 1 << 24, 32, 8
#: Integers of a block that a task sorts or looks up at once.
SLICE_CODES = 1 << 22
#: Equal integers, and compared ones, that a task holds at once.
AT_ONCE = 1 << 21
#: Ids divisible by this make a set of queries in proportion to the rows, for callers that search.
EVERY = 20
STEP = 1 << 14


class Sound(NamedTuple):
    """How samples are stored, and how they are framed."""

    rate: int = 11025
    sample: str = "<i2"  # a numpy type
    centre: float = 0.0
    frame: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0


#: Texts' bytes stand in for recordings: unsigned 8-bit samples, with frames to suit some kilobytes.
TEXT_SOUND = Sound(sample="u1", centre=100.0, frame=256, hop=64, low=200.0, high=5000.0)

#: (shape, first pitch class, number of classes, frames): six shapes at several places.
FILTERS = tuple((i % 6, (5 * i) % 7, 4 + (i % 3), (16, 8, 12, 4)[i % 4]) for i in range(16))
#: A filter's quantisation steps: none of a log ratio, and this much to either side.
QUANTUM = 0.12


@functools.lru_cache(maxsize=4)
def folding(sound: Sound) -> tuple[np.ndarray, np.ndarray]:
    """The window, and the matrix from spectrum bins to pitch classes."""
    freq = np.fft.rfftfreq(sound.frame, 1 / sound.rate)
    fold = np.zeros((len(freq), CLASSES), dtype=np.float32)
    used = np.flatnonzero((freq >= sound.low) & (freq <= sound.high))
    pitch = np.round(12 * np.log2(freq[used] / 440.0)).astype(int) % CLASSES
    fold[used, pitch] = 1.0
    return np.hamming(sound.frame).astype(np.float32), fold


def chroma(media: bytes, sound: Sound) -> np.ndarray:
    """One row of pitch-class shares for each frame."""
    samples = np.frombuffer(media, dtype=sound.sample, count=len(media) // np.dtype(sound.sample).itemsize).astype(np.float32) - sound.centre
    if len(samples) < sound.frame:
        return np.zeros((0, CLASSES), dtype=np.float32)
    window, fold = folding(sound)
    frames = np.lib.stride_tricks.sliding_window_view(samples, sound.frame)[:: sound.hop]
    rows = [np.square(np.abs(np.fft.rfft(frames[i : i + STEP] * window, axis=1))).astype(np.float32) @ fold for i in range(0, len(frames), STEP)]
    energy = np.concatenate(rows)
    total = energy.sum(axis=1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 0)


def codes(media: bytes, sound: Sound) -> tuple[int, np.ndarray]:
    """The number of frames, and a packed 32-bit integer for each frame that starts a full filter width."""
    frames = chroma(media, sound)
    n = len(frames) - WIDTH + 1
    if n < 1:
        return len(frames), np.zeros(0, dtype=np.int32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    np.cumsum(np.cumsum(frames, axis=0), axis=1, out=image[1:, 1:])

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t1 : t1 + n, p1] - image[t0 : t0 + n, p1] - image[t1 : t1 + n, p0] + image[t0 : t0 + n, p0]

    packed = np.zeros(n, dtype=np.uint32)
    for shape, p, height, w in FILTERS:
        q, t = p + height, w // 2
        whole, half, mid = area(0, w, p, q), (p + q) // 2, max(1, w // 3)
        if shape == 0:
            a, b = whole, area(0, w, 0, CLASSES) - whole
            b = b * (height / (CLASSES - height))
        elif shape == 1:
            a = area(0, w, half, q)
            b = whole - a
        elif shape == 2:
            a = area(0, t, p, q)
            b = whole - a
        elif shape == 3:
            a = area(0, t, p, half) + area(t, w, half, q)
            b = whole - a
        elif shape == 4:
            a = area(0, w, p + height // 3, q - height // 3)
            b = whole - a
        else:
            a = area(mid, w - mid, p, q)
            b = whole - a
        ratio = np.log((0.01 + a) / (0.01 + b))
        level = (ratio >= -QUANTUM).astype(np.uint32) + (ratio >= 0) + (ratio >= QUANTUM)
        packed = packed << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return len(frames), packed.view(np.int32)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """offset of b against a, integers that agree there, and the share of wrong bits over the overlap (1 if there is none)."""
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    votes = np.zeros(len(a) + len(b), dtype=np.int64)
    for i in np.flatnonzero(right > left):
        np.add.at(votes, i - order[left[i] : right[i]] + len(b), 1)
    if not votes.any():
        return 0, 0, 1.0
    offset = int(votes.argmax()) - len(b)
    first, last = max(0, offset), min(len(a), len(b) + offset)
    wrong = np.bitwise_count(a[first:last].view(np.uint32) ^ b[first - offset : last - offset].view(np.uint32)).sum()
    return offset, int(votes.max()), float(wrong) / (32 * (last - first))


def with_codes(df: DataFrame, media: str = "media", sound: Sound = Sound(), into: str = "chroma") -> DataFrame:
    """df and struct(n_frames, codes) of its media column; a column named into is replaced."""

    @F.pandas_udf("n_frames long, codes array<int>")
    def fingerprints(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codes(m or b"", sound) for m in column], columns=["n_frames", "codes"])

    return df.withColumn(into, fingerprints(media))


def aligned_rows(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b):
        x, y = np.asarray(x, dtype=np.int32), np.asarray(y, dtype=np.int32)
        offset, votes, wrong = align(x, y)
        rows.append((offset, votes, wrong, min(len(x), len(y) + offset) - max(0, offset)))
    return pd.DataFrame(rows, columns=["offset", "votes", "bit_error", "overlap"])


def landmark_pairs(classes: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """a, b: classes (id, codes) that meet at a landmark, and agree around it."""
    hashed = F.array_sort(F.transform(F.array_distinct("codes"), lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("c"))))
    at = lambda c, step: F.get("codes", (F.array_position("codes", c) - 1 + step).cast("int"))  # noqa: E731  null beyond the ends
    mark = F.transform(F.slice(hashed, 1, landmarks), lambda x: F.struct(x["c"].alias("mark"), F.array(*[at(x["c"], step) for step in AROUND]).alias("near")))
    marks = classes.select("id", F.explode(mark).alias("m")).select("id", "m.mark", "m.near")
    ends = marks.groupBy("mark").agg(F.min(F.struct("id", "near")).alias("low"), F.max(F.struct("id", "near")).alias("high")).where("low.id < high.id")
    ends = materialize(ends, "landmarks")
    met = marks.join(ends, "mark").select("id", "near", F.explode(F.array("low", "high")).alias("other")).where("id <> other.id")
    wrong = lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit((1 << 32) - 1)))
    bits = F.array_compact(F.zip_with("near", "other.near", wrong))
    agree = F.aggregate(bits, F.lit(0), lambda n, b: n + b) <= MAX_LOCAL_ERROR * 32 * F.size(bits)
    return met.where(agree).select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct()


def least_overlap(n: Column, m: Column) -> Column:
    """Integers that two recordings of n and m have to overlap by."""
    return F.greatest(F.lit(MIN_OVERLAP), F.least(n, m) / 2)


def alignments(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, offset and bit_error of those pairs (a, b) of classes (id, codes) that align."""
    aligned = F.pandas_udf(aligned_rows, "offset long, votes long, bit_error double, overlap long")
    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("codes").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("codes").alias("y")), "b")
    found = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), aligned("x", "y").alias("r")).select("a", "b", "n", "m", "r.*")
    return found.where((F.col("bit_error") <= MAX_BIT_ERROR) & (F.col("overlap") >= least_overlap(F.col("n"), F.col("m")))).select("a", "b", "offset", "bit_error")


class Recordings(NamedTuple):
    """A block of recordings: the codes of number i are codes[starts[i] : starts[i + 1]]."""

    ids: np.ndarray
    roots: np.ndarray
    codes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Recordings:
        lists = pa.concat_arrays(rows["codes"].chunks) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
        starts = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=starts[1:])
        return cls(rows["id"].to_numpy(), rows["root"].to_numpy(), lists.flatten().to_numpy(zero_copy_only=False), starts)

    def part(self, first: int, last: int) -> Recordings:
        at = self.starts[first : last + 1]
        return Recordings(self.ids[first:last], self.roots[first:last], self.codes[at[0] : at[-1]], at - at[0])

    def slices(self) -> Iterator[Recordings]:
        """Parts of SLICE_CODES integers at most, a recording at least."""
        first = 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + SLICE_CODES, "right")) - 1)
            yield self.part(first, last)
            first = last

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))


def wrong_bits(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits that differ between x[at:at+size] and y[to:to+size] for each of at, to and sizes (all 1 or more)."""
    differ = np.bitwise_count(x[each(at, sizes)].view(np.uint32) ^ y[each(to, sizes)].view(np.uint32))
    return np.add.reduceat(differ, np.cumsum(sizes) - sizes, dtype=np.int64)


def aligned_pairs(queries: Recordings, rows: Recordings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries and of rows of other roots that align, as align() of the one of lower id with the other finds."""
    order = np.argsort(queries.codes, kind="stable")
    known, owner, row_of = queries.codes[order], queries.owners()[order], rows.owners()
    place = order - queries.starts[owner]
    left = np.searchsorted(known, rows.codes, "left")
    times = np.searchsorted(known, rows.codes, "right") - left
    met = np.concatenate([[0], np.cumsum(times)])[rows.starts]
    found, first, n = [], 0, len(rows.ids)
    while first < n:
        last = max(first + 1, int(np.searchsorted(met, met[first] + AT_ONCE, "right")) - 1)
        if met[last] - met[first] <= AT_ONCE:
            some = slice(rows.starts[first], rows.starts[last])
            at = each(left[some], times[some])
            row = np.repeat(row_of[some], times[some])
            here = np.repeat(np.arange(some.start, some.stop) - rows.starts[row_of[some]], times[some])
            apart = queries.roots[owner[at]] != rows.roots[row]
            found.append(checked(queries, rows, owner[at][apart], row[apart], (here - place[at])[apart]))
        elif (half := len(queries.ids) // 2) > 0:  # one row that meets very many: the queries half by half
            for low, high in ((0, half), (half, len(queries.ids))):
                found += [(q + low, r + first) for q, r in aligned_pairs(queries.part(low, high), rows.part(first, last))]
        elif queries.roots[0] != rows.roots[first] and links(*sorted([(queries.ids[0], queries.codes), (rows.ids[first], rows.part(first, last).codes)], key=lambda x: x[0])):
            found.append((np.array([0]), np.array([first])))
        first = last
    return found


def links(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
    """Whether two recordings (id, codes) align, from one pair of them."""
    offset, votes, wrong = align(a[1], b[1])
    overlap = min(len(a[1]), len(b[1]) + offset) - max(0, offset)
    return votes > 0 and wrong <= MAX_BIT_ERROR and overlap >= max(MIN_OVERLAP, min(len(a[1]), len(b[1])) / 2)


def checked(queries: Recordings, rows: Recordings, q: np.ndarray, r: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs q, r with an equal integer each shift (row's place less query's) those that align."""
    flip = rows.ids[r] > queries.ids[q]
    offset = np.where(flip, -shift, shift)  # the place in the one of lower id less that in the other
    span = int(np.abs(offset).max(initial=0)) + 1
    tally, votes = np.unique((r * len(queries.ids) + q) * (2 * span) + offset + span, return_counts=True)
    pair, offset = tally // (2 * span), tally % (2 * span) - span
    if not len(pair):
        return q[:0], r[:0]
    begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    most = np.repeat(np.maximum.reduceat(votes, begins), np.diff([*begins, len(pair)]))
    top = np.flatnonzero(votes == most)
    top = top[np.concatenate([[True], pair[top][1:] != pair[top][:-1]])]  # the least offset of those with most votes
    r, q, offset = pair[top] // len(queries.ids), pair[top] % len(queries.ids), offset[top]
    shift = np.where(rows.ids[r] > queries.ids[q], -offset, offset)  # the row's place less the query's again
    n, m = np.diff(rows.starts)[r], np.diff(queries.starts)[q]
    overlap = np.minimum(n, m + shift) - np.maximum(0, shift)
    long_ = overlap >= np.maximum(MIN_OVERLAP, np.minimum(n, m) / 2)
    q, r, shift, overlap = q[long_], r[long_], shift[long_], overlap[long_]
    in_row, in_query = rows.starts[r] + np.maximum(0, shift), queries.starts[q] + np.maximum(0, -shift)
    for part in (2, 1):  # half the overlap rejects most pairs, the whole of it decides
        size = -(-overlap // part)
        good, at = np.zeros(len(q), dtype=bool), 0
        ends = np.cumsum(size)
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            wrong = wrong_bits(rows.codes, queries.codes, in_row[at:to], in_query[at:to], size[at:to])
            good[at:to] = wrong / (32 * overlap[at:to]) <= MAX_BIT_ERROR
            at = to
        q, r, overlap, in_row, in_query = q[good], r[good], overlap[good], in_row[good], in_query[good]
    return q, r


def block_forest(queries: pa.Table, rows: pa.Table) -> pa.Table:
    """u, v: roots that connect what alignments of a block of queries with a block of rows connect."""
    queries, rows = Recordings.of(queries), Recordings.of(rows)
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    for some, others in itertools.product(queries.slices(), rows.slices()):
        for q, r in aligned_pairs(some, others):
            for u, v in np.unique(np.stack([some.roots[q], others.roots[r]], axis=1), axis=0).tolist():
                u, v = sorted((top(u), top(v)))
                parent[v] = u
    joined = [(v, u) for v, u in parent.items() if u != v]
    return pa.table({"u": pa.array([v for v, _ in joined], pa.int64()), "v": pa.array([u for _, u in joined], pa.int64())})


def search_links(rooted: DataFrame, block_codes: int = BLOCK_CODES, least: int = MIN_BLOCKS) -> DataFrame:
    """u, v: links between roots that connect what alignments of queries with any recording connect; rooted: id, root, codes, query."""
    usable = rooted.where(F.size("codes") >= MIN_OVERLAP)
    asked, every = usable.agg(F.sum(F.when(F.col("query"), F.size("codes"))), F.sum(F.size("codes"))).first()
    if asked == every:
        return whole_links(usable, max(min(least, MIN_WHOLE_BLOCKS), -(-(every or 0) // block_codes)))
    n_asked, n_every = max(1, -(-(asked or 0) // block_codes)), max(least, -(-(every or 0) // block_codes))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = usable.where("query").select("id", "root", "codes", of(n_asked).alias("asked"), all_(n_every).alias("part"))
    rows = usable.select("id", "root", "codes", all_(n_asked).alias("asked"), of(n_every).alias("part"))
    return queries.groupBy("asked", "part").cogroup(rows.groupBy("asked", "part")).applyInArrow(block_forest, "u long, v long")


def whole_links(usable: DataFrame, n: int) -> DataFrame:
    """search_links where every recording is a query: each two of n blocks meet once, so recordings are shuffled n + 1 times."""
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    from_, to = F.sequence(block, F.lit(n - 1)), F.sequence(F.lit(0), block)
    queries = usable.select("id", "root", "codes", block.alias("asked"), F.explode(from_).alias("part"))
    rows = usable.select("id", "root", "codes", F.explode(to).alias("asked"), block.alias("part"))
    pairs = n * (n + 1) // 2
    queries, rows = (side.repartition(4 * pairs, "asked", "part") for side in (queries, rows))  # more parts than pairs, so that few pairs share one
    return queries.groupBy("asked", "part").cogroup(rows.groupBy("asked", "part")).applyInArrow(block_forest, "u long, v long")


def class_roots(classes: DataFrame, whole: bool = False) -> DataFrame:
    """id and root, the least id that alignments between classes (id, codes, query; read more than once) reach; whole: every class is a query."""
    if whole:
        joined = components(search_links(classes.withColumn("root", F.col("id")))).toDF("id", "root")
        return classes.select("id").join(joined, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    found = alignments(classes, materialize(landmark_pairs(classes), "landmark-pairs"))
    roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id")
    rooted = materialize(classes.join(roots, "id", "left").select("id", "codes", "query", F.coalesce("root", "id").alias("root")), "chroma-rooted")
    joined = components(search_links(rooted)).toDF("root", "top")
    return rooted.select("id", "root").join(joined, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def group_recordings(recordings: DataFrame, media_id: str = "media_id", queries: Column | None = None) -> DataFrame:
    """recordings (the id, media_digest, n_frames and codes; read more than once) with digest and group_id, the least id that alignments reach.

    queries tells which recordings are aligned with all others: every one if it is None. Columns digest and group_id are replaced, all others stay.
    """
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    query, class_ = free_name(recordings, "_query"), free_name(recordings, "_class")
    rows = recordings.withColumn(query, asked).drop("group_id").withColumn("digest", F.sha2(F.array_join("codes", ","), 256))
    rows = rows.withColumn(class_, F.when(F.size("codes") > 0, F.concat(F.lit("c"), "digest")).otherwise(F.concat(F.lit("m"), "media_digest")))
    id_ = F.coalesce(F.min(media_id), F.min(F.xxhash64(class_).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))))
    found = rows.where(F.col(class_).isNotNull()).groupBy(class_)
    classes = materialize(found.agg(id_.alias("id"), F.any_value("codes").alias("codes"), F.max(query).alias("query")), "chroma-classes")
    roots = class_roots(classes.where(F.size("codes") > 0).select("id", "codes", "query"), queries is None)
    group = classes.select(class_, "id").join(roots, "id", "left").select(class_, F.coalesce("root", "id").alias("group_id"))
    return rows.join(materialize(group, "chroma-groups"), class_, "left").withColumn("group_id", F.coalesce("group_id", media_id)).drop(class_, query)


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all documents, whose bytes are read as recordings: there is no table of sounds.

    Every document is aligned with all others, so no alignment between different documents is left out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("media"))
    found = with_codes(docs, "media", TEXT_SOUND)
    recordings = materialize(found.select("doc_id", F.sha2("media", 256).alias("media_digest"), "chroma.n_frames", "chroma.codes"), "chroma")
    return group_recordings(recordings, "doc_id").select(
        "doc_id", "n_frames", F.size("codes").cast("long").alias("n_codes"), F.col("digest").alias("codes_sha256"), "group_id"
    )
