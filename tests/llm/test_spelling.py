import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from orderloom.llm import spelling

COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_vocab(docs, slip):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(vocab):
    form, near = {}, {}
    for w, n in vocab.items():
        found = [o for o in vocab if o != w and one_edit(w, o)]
        near[w] = len(found)
        best = min(found, key=lambda o: (-vocab[o], o), default=None)
        form[w] = best if best and vocab[best] >= 5 * n else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], vocab[form[w]] if form[w] else None))
    return sorted(map(str, out))


def texts(seed=8):
    rng = random.Random(seed)
    words = ["colour", "color", "ééééèé", "banana", "bananna", "aaaaaa", "aaaaaaa", "aaaaaaaa", "ÀÉÎÕÜß", "listen", "silent", "enlist", "tinsel", "×÷×÷×÷"]
    for base in [*words]:
        for _ in range(12):
            at, c = rng.randrange(len(base)), rng.choice("abcxyzéÿß")
            words += [base[:at] + c + base[at + 1 :], base[:at] + c + base[at:], base[:at] + base[at + 1 :], "".join(rng.sample(base, len(base)))]
    out = []
    for i in range(250):
        out.append((i, " ".join(rng.choice(words[: 10 ** rng.randint(1, 3)]) for _ in range(40)).title() if i % 3 == 0 else ".".join(rng.choice(words) for _ in range(60))))
    chain = [("abcdefgh", 6), ("abcdefgx", 40), ("abcdefyx", 250), ("abcdezyx", 1500)]
    out += [(1000 + k, " ".join(w for w, n in chain for _ in range(n)))  for k in range(1)]
    out += [(None, "withoutid " * 7), (None, None), (5, ""), (6, "rowagain " * 3), (6, "rowagain " * 3), (7, ("m" * 30_000 + " ") * 5 + ("m" * 29_999 + " ") * 40)]
    return out


@pytest.mark.parametrize("slip", [True, False])
def test_variants_against_brute_force(spark, slip):
    docs = texts()
    vocab = brute_vocab(docs, slip)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = spelling.variants(spelling.vocabulary(spelling.words(df, slip=slip)))
    rows = found.collect()
    assert sorted(str(tuple(r[c] for c in COLS)) for r in rows) == brute_variants(vocab)
    assert any(r.form and r.root not in (r.form, r.word) for r in rows) and max(r.n_near for r in rows) > 10


def test_query_and_sql(spark, tmp_path):
    docs = [(*d, d[1], 1) for d in texts(9)]
    spark.createDataFrame(docs, "doc_id long, text string, word string, n int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(str(tuple(r[c] for c in COLS)) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).collect())
    assert found == brute_variants(brute_vocab([d[:2] for d in docs], True))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert found == sorted(map(str, con.sql(f"select {', '.join(COLS)} from ({spelling.OP12_SQL})").fetchall()))


def test_pairs_come_once_and_exactly(spark):
    rng = random.Random(3)
    vocab = {"".join(rng.choice("aabcé") for _ in range(rng.randint(1, 6))): rng.randint(5, 99) for _ in range(400)}
    pairs = spelling.near_pairs(spark.createDataFrame(list(vocab.items()), "word string, n long"))
    want = sorted((a, b) for a in vocab for b in vocab if a != b and one_edit(a, b))
    assert sorted((r.word, r.other) for r in pairs.collect()) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(spelling.words(df))).collect() == []
