"""Quality rules: base word statistics and compression bands.

A text's zstandard ratio (bytes over compressed bytes less the frame's own) is
taken over the whole text and over chunks, into which every text is dealt evenly,
the tail included; a text below two chunks is one. The band depends on the length: a
ratio above it marks repetitive text, one below it incompressible text. A text
is rejected if the whole is out of its band, or if more than a quarter of its
chunks are. The zstd_ratio returned is that of all bytes, frame included.

Row-wise and without a shuffle. Null and empty texts have no words and fail the
base rules. Repeated rows get equal results; other columns are untouched.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import free_name, table, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Chunks have this many bytes to twice as many; a shorter text is one chunk.
CHUNK_BYTES = 1024
MAX_CHUNKS_OUT = 0.25
LEVEL = 3
#: Bytes of an empty frame.
FRAME_BYTES = len(zstandard.ZstdCompressor(level=LEVEL).compress(b""))
#: (bytes, lowest ratio, highest ratio) at successive powers of two; between them limits run straight over the logarithm
#: of the bytes, beyond the ends they stay. They are the least and greatest ratios of the first so many bytes of the 8,426
#: documents that are labelled good and pass the base rules in parts 0 to 3 of check_s, widened by 5 and 2 percent; above
#: 32,768 bytes, where labels are too few, the upper limit goes on rising as in the octave before.
BANDS = (
    (128, 1.04, 1.67), (256, 1.22, 1.80), (512, 1.37, 1.93), (1024, 1.56, 2.09), (2048, 1.76, 2.26), (4096, 1.86, 2.33),
    (8192, 2.03, 2.43), (16384, 2.13, 2.49), (32768, 2.19, 2.56), (65536, 2.19, 2.63), (131072, 2.19, 2.70),
)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, zstd_ratio double, chunks_out double, kept boolean"


def limits(size: int) -> tuple[float, float]:
    """The lowest and the highest ratio of a text of size bytes."""
    at = min(max(math.log2(max(size, 1) / BANDS[0][0]), 0), len(BANDS) - 1)
    below = min(int(at), len(BANDS) - 2)
    (_, low, high), (_, next_low, next_high) = BANDS[below : below + 2]
    return low + (at - below) * (next_low - low), high + (at - below) * (next_high - high)


def in_band(size: int, packed: int) -> bool:
    """packed: the bytes of the compressed frame."""
    low, high = limits(size)
    return low <= size / max(packed - FRAME_BYTES, 1) <= high


def chunks_of(raw: bytes) -> list[bytes]:
    """Even chunks that hold every byte."""
    n = max(1, len(raw) // CHUNK_BYTES)
    return [raw[i * len(raw) // n : (i + 1) * len(raw) // n] for i in range(n)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more, the first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, n = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            n += at + 3 - max(at, covered)
            covered = at + 3
    return n


def judge(text: str, compress) -> tuple:
    raw = text.encode()
    words = raw.split()  # of bytes: at the six ASCII white-space characters
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    packed = len(compress(raw))
    chunks = chunks_of(raw)
    sizes = [packed] if len(chunks) == 1 else [len(compress(c)) for c in chunks]
    out = sum(not in_band(len(c), n) for c, n in zip(chunks, sizes)) / len(chunks)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat,
        failed, len(raw) / packed, out, not failed and in_band(len(raw), packed) and out <= MAX_CHUNKS_OUT,
    )


def with_quality(df: DataFrame, text: str = "text", into: str = "quality_rules") -> DataFrame:
    """df and a struct of FIELDS about its text column; a column named into is replaced."""

    @F.pandas_udf(FIELDS)
    def rules(texts: pd.Series) -> pd.DataFrame:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pd.DataFrame([judge(t, compress) for t in texts], columns=names)

    return df.withColumn(into, rules(text_of(text)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the compression bands, with their own columns."""
    rules = free_name(docs, "_rules")
    return with_quality(docs, into=rules).where(F.col(f"{rules}.kept")).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, into="r").select("doc_id", "r.*")
