import math
import random
import re

import numpy as np
import zstandard

from orderloom.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def test_base_statistics_against_brute_force():
    rng, compress = random.Random(2), zstandard.ZstdCompressor(level=3).compress
    bits = ["a", "b", "c ", " ", "\n", "é", "#", " ", "\x1c", "\t", "a b c\n", "x" * 9]
    for _ in range(800):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 200)))
        assert quality.judge(t, compress)[:6] == brute(t), repr(t)


def test_bands(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    noise = "".join(chr(rng.randint(0x21, 0x7E)) for _ in range(20000))
    noise = " ".join(noise[i : i + 300] for i in range(0, len(noise), 300))
    loop = " ".join(f"{w} row" for w in ["same"] * 900) + " " + " ".join(map(str, range(500)))
    df = spark.createDataFrame([(1, prose, 1), (2, noise, 1), (3, loop, 1), (4, None, 1), (5, "", 1), (None, prose, 1)], "doc_id long, text string, _rules int")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert quality.with_quality(df.limit(0)).count() == 0


def words_of(rng, letters, size):
    text = ""
    while len(text) < size:
        text += "".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) + " "
    return text[:size]


def test_bands_reject_short_texts_tails_and_parts():
    rng, compress = random.Random(5), zstandard.ZstdCompressor(level=quality.LEVEL).compress
    junk = lambda n: words_of(rng, [chr(c) for c in range(0x21, 0x7F)], n)
    prose = lambda n: words_of(rng, "etaoinshr", n)
    kept = lambda t: quality.judge(t, compress)[-1]
    for size in (450, 900, 1500, 3000, 8191, 20000):
        failed, *_, ok = quality.judge(junk(size), compress)[5:]
        assert not failed and not ok, size
    assert all(kept(prose(n)) for n in (8191, 12000, 20000))
    assert not kept(prose(4900) + junk(3291)) and not kept(prose(12000) + junk(8000))
    # Repeats in one part and noise in another leave the whole in its band, but not the chunks.
    mixed = prose(11000) + junk(3000) + ("the same line once more and again, " * 200)[:5000]
    *_, failed, ratio, out, ok = quality.judge(mixed, compress)
    assert not failed and quality.in_band(len(mixed), len(compress(mixed.encode()))) and out > quality.MAX_CHUNKS_OUT and not ok


def test_chunks_hold_every_byte():
    for n in (0, 1, 1023, 1024, 2047, 2048, 3071, 5000, 8191, 10001):
        raw = bytes(i % 251 for i in range(n))
        parts = quality.chunks_of(raw)
        assert b"".join(parts) == raw and all(min(n, 1024) <= len(p) < 2048 for p in parts)


def plain_verdict(text, rates):
    """Limits by interpolation over a table of every octave, chunks cut one by one; rates: ratio of some bytes."""
    def limits(n):
        x = math.log2(max(n, 1))
        at = [math.log2(b) for b, *_ in quality.BANDS]
        return np.interp(x, at, [b[1] for b in quality.BANDS]), np.interp(x, at, [b[2] for b in quality.BANDS])

    def fits(raw):
        low, high = limits(len(raw))
        return low - 1e-12 <= rates(raw) <= high + 1e-12

    raw = text.encode()
    n, bounds = max(1, len(raw) // 1024), []
    for i in range(n + 1):
        bounds.append(len(raw) * i // n)
    chunks = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
    out = sum(not fits(c) for c in chunks)
    return out / n, fits(raw) and 4 * out <= n


def test_bands_against_a_plain_version():
    rng, packer = random.Random(6), zstandard.ZstdCompressor(level=quality.LEVEL)
    empty = len(packer.compress(b""))
    rates = lambda raw: len(raw) / max(len(packer.compress(raw)) - empty, 1)
    kinds = [lambda n: words_of(rng, "etaoinshr", n), lambda n: words_of(rng, [chr(c) for c in range(0x21, 0x7F)], n), lambda n: ("again and again, " * n)[:n], lambda n: words_of(rng, "éüßaeiou漢", n)]
    seen = set()
    for _ in range(300):
        text = "".join(rng.choice(kinds)(int(rng.paretovariate(0.7) * 60) % 30_000) for _ in range(rng.randint(1, 4)))
        *_, failed, ratio, out, kept = quality.judge(text, packer.compress)
        want_out, fits = plain_verdict(text, rates)
        assert (out, kept) == (want_out, not failed and fits)
        assert abs(ratio - (len(text.encode()) / len(packer.compress(text.encode())))) < 1e-12
        seen.add((failed, kept, out > 0))
    assert len(seen) >= 4
    for size, low, high in quality.BANDS:  # at a band's edge a ratio is still in
        assert quality.limits(size) == (low, high)


def test_very_long_text_and_repeated_rows(spark):
    rng = random.Random(7)
    text = words_of(rng, "etaoinshr", 2_000_000)
    rows = quality.with_quality(spark.createDataFrame([(1, text), (1, text), (2, "x" * 1_000_000)], "doc_id long, text string"), into="r").select("doc_id", "r.*").collect()
    assert rows[0] == rows[1] and rows[0].n_words == len(text.split()) and rows[2].n_words == 1 and rows[2].base_failed
