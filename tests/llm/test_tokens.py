import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from orderloom.llm import byte_bpe, letters, token_counts

ODD = [
    "", " ", "a", "Hello, World's   café", "ΑΣ ΣΑΣ Σ", "İstanbul", "ȩ́ ẛ̣", "x\x1cy\x1dz\x85w v u​q",
    "<|startoftext|>hi <|endoftext|>", "a<|endoftext|>b <| startoftext|>", "\U0001f600\U0001f468‍\U0001f469 é", "1234 ٣٤ ²½ Ⅷ", "don't I'LL they'Re 's",
    "a" * 5000, "ab" * 3000 + " " + "!" * 4000, "\n\n \t  x  \n", "日本語テキスト カタカナ한국어", "अनुच्छेद ไทย", "ͅΣͅ", "KKſ",
]


def texts():
    rng = random.Random(5)
    alphabet = "abcdefgTHE  \n\t'´éüßñ0123456789.,!?-_<|>́ 　漢字\U0001f600"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(1500)]


def test_counts_equal_the_library():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library, ours = Tokenizer.from_file(path), token_counts.WordCounter(path)
    for t in texts():
        assert ours.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


CHARS = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]


def test_every_letter_as_the_libraries_know_it():
    """Classes and lower forms of all code points, and the newer ones in several places of a text."""
    single, low = {bytes([i]): i for i in range(256)}, normalizers.Lowercase()
    for pattern in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"):
        other, ours = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=single, special_tokens={}), letters.Splitter(pattern)
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for i in range(0, len(CHARS), 3000):
            text = "".join(CHARS[i : i + 3000])
            found = "".join(ours(text))
            assert found.encode() == bytes(other.encode_ordinary(text)) and found == "".join(p for p, _ in split.pre_tokenize_str(text)), (pattern, i)
    for i in range(0, len(CHARS), 3000):
        text = "a".join(CHARS[i : i + 3000])
        assert letters.lowered(text) == low.normalize_str(text)
    path, bpe = public_tokenizers.path(token_counts.VOCABULARY), public_tokenizers.path(byte_bpe.VOCABULARY)
    library, ours, codec = Tokenizer.from_file(path), token_counts.WordCounter(path), byte_bpe.Codec(bpe, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    newer = [c for c in CHARS if regex.match(r"\p{L}|\p{N}", c) and not regex.match(letters.pinned(r"\p{L}|\p{N}"), c, regex.V1) or ord(c) in letters.LOWER]
    assert len(newer) > 17_000 and all(map(letters.exotic, newer))
    for c in newer[:200] + newer[200::200]:
        for text in (f"ab{c}cd", f"1{c}2 {c}'s", f" {c}", f"!{c}!{c}{c}Σ"):
            assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids), (hex(ord(c)), text)
            assert list(byte_bpe.array("I", codec.encode(text))) == other.encode_ordinary(text), (hex(ord(c)), text)


def test_counts_in_slices(monkeypatch):
    ours = token_counts.WordCounter(public_tokenizers.path(token_counts.VOCABULARY))
    text = " ".join(texts())
    whole = ours.count(text)
    monkeypatch.setattr(token_counts, "SLICE", 97)
    assert ours.count(text) == whole


def test_encoding_equals_the_library(monkeypatch):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    for t in texts():
        packed = ours.encode(t)
        assert list(byte_bpe.array("I", packed)) == library.encode_ordinary(t), repr(t)
        assert ours.decode(packed) == t.encode()
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    joined = " ".join(texts())
    assert list(byte_bpe.array("I", ours.encode(joined))) == library.encode_ordinary(joined)


def test_rank_queue_orders_by_rank_then_position():
    rng, q = random.Random(1), byte_bpe.RankQueue()
    rows = [(rng.randint(0, 50_255), rng.randint(0, 99)) for _ in range(2000)]
    for r in rows:
        q.push(*r)
    assert [q.pop() for _ in rows] == sorted(rows)
    assert not q.top


def test_columns_and_edges(spark):
    df = spark.createDataFrame(
        [(1, "Hello world", 9), (1, "Hello world", 9), (None, None, 3), (2, "", None)], "doc_id long, text string, n_tokens long"
    )
    p, pattern = public_tokenizers.path, public_tokenizers.PATTERN
    rows = token_counts.with_token_counts(df, p(token_counts.VOCABULARY)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [0, 2, 2, 0]
    out = byte_bpe.with_digests(df, p(byte_bpe.VOCABULARY), pattern).orderBy("doc_id").collect()
    assert out[0].n_tokens == 0 and out[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[1].decoded_sha256 == out[2].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    trip = byte_bpe.with_decoding(byte_bpe.with_encoding(df, p(byte_bpe.VOCABULARY), pattern), p(byte_bpe.VOCABULARY), pattern)
    assert {(r.text or "").encode() == bytes(r.decoded) for r in trip.collect()} == {True}
    assert byte_bpe.with_digests(df.limit(0), p(byte_bpe.VOCABULARY), pattern).count() == 0


def test_columns_that_clash_with_the_digests(spark):
    import public_tokenizers as p
    from orderloom.llm import byte_bpe

    df = spark.createDataFrame([("a b", 1, 2, 3)], "text string, _digest int, N_TOKENS int, ids int")
    found = byte_bpe.with_digests(df, p.path(byte_bpe.VOCABULARY), p.PATTERN)
    assert sorted(found.columns) == ["_digest", "decoded_sha256", "ids", "ids_sha256", "n_tokens", "text"]
    row = found.first()
    assert (row._digest, row.ids) == (1, 3) and row.n_tokens > 0
