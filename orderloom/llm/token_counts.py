"""Token counts by heap-and-linked-list byte-pair merging.

Every word starts as a linked list of byte symbols, the last one marked as a
word end. A heap holds adjacent pairs by (rank, position); the lowest is popped,
skipped when its neighbours have changed since, and merged otherwise. A word's
count is its number of initial symbols minus its merges; no token identifier is
ever looked up.

Row-wise and without a shuffle: counts come from a vectorized function over the
text column, so work is spread by the scan's own splits. Each worker keeps a
bounded table of word counts. Long texts are counted in slices that end at
white space, which no token crosses.

Null text counts as empty: zero bytes, zero tokens, not over the limit. Repeated
rows, ties and extra columns do not matter; every row keeps its own result.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import table, text_of
from orderloom.llm.letters import Splitter, lowered

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
SLICE = 1 << 20
CACHED_WORDS = 200_000
CACHED_LENGTH = 64


def count_pieces(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the lowest-ranked adjacent pair, leftmost first, is merged until none is left."""
    n = len(symbols)
    after = [*range(1, n), -1] if n else []
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if symbols[i] else -1
        if j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        k = after[i] = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordCounter(dict):
    """Word to token count, worked out on first use and kept within a bound."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        self.ranks = {(a, b): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = Splitter(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.space = regex.compile(r"\s")

    def __missing__(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        n = count_pieces(symbols, self.ranks)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return sum(map(self.__getitem__, self.words(lowered(text))))

    def slices(self, text: str):
        at = 0
        while len(text) - at > SLICE:
            cut = self.space.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def count(self, text: str) -> int:
        if "<|" not in text:
            return sum(map(self.plain, self.slices(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(s) for p in parts for s in self.slices(p))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def with_token_counts(df: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """df and the token count of its text column; vocabulary is a path that workers can open. A column named into is replaced."""

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        count = counter(vocabulary).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return df.withColumn(into, counts(text_of(text)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    counted = with_token_counts(docs, public_tokenizers.path(VOCABULARY))
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )
