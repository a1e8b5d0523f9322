import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orderloom.llm import simhash
from orderloom.llm.components import components


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[find(max(a, b))] = find(min(a, b)) if find(max(a, b)) != find(min(a, b)) else parent[find(max(a, b))]
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_fingerprints_against_brute_force(monkeypatch):
    rng = random.Random(1)
    bits = ["The", "É", "cat", "sat", " ", "  ", "\n", "\x1c", " ", "ON", "漢字", "\t"]
    texts = ["", " ", "one", "one two", "A b C", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(200))]
    for step in (1 << 16, 7):
        monkeypatch.setattr(simhash, "STEP", step)
        for t in texts:
            assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t), repr(t)


def clustered(n, seed=2):
    """Distinct fingerprints: random ones, chains of small steps, and one dense ball that shares most of its bytes."""
    rng, out = random.Random(seed), set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            out.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    for _ in range(300):
        x = base
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(20)
        out.add(x)
    out.add(0)
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize("block", [16, 1024])
def test_components_against_all_pairs(spark, block):
    fps = clustered(250)
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    near = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 3) + i + 1]
    want = roots_of(fps, near)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(df, block)
    assert {(r.u, r.v) for r in found.collect()} <= {(a, b) for p in near for a, b in (p, p[::-1])} | {(a, b) for a in fps for b in fps if want[a] == want[b]}
    got = {r.node: r.root for r in components(found).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000 + i, 5000) for i in range(300)]
    df = spark.createDataFrame(chain + hub + hub[:5] + [(7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == 1000
    assert components(df.where(F.lit(False))).count() == 0


def test_documents(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n)]
    rows = []
    for g in range(12):
        base = words(300)
        for c in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(300)] = "x"
            rows.append((g * 100 + c, " ".join(copy).title(), "en", "s", c))
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 1), (None, "  ", "en", "s", 1), (0, rows[0][1], "en", "s", 0), (None, "only one here", "en", "s", 1), (None, "only one here", "fr", "s", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = simhash.op4_simhash(spark, str(tmp_path)).collect()
    fp = [brute_fingerprint(r[1] or "") for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = roots_of(range(len(rows)), near)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root[i]] = min(ids.get(root[i], r[0]), r[0])
    want = sorted(map(str, ((r[0], f"{fp[i]:016x}", ids.get(root[i])) for i, r in enumerate(rows))))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in out) == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(ids.get(x)) for x in set(root.values()))
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_equal_ids_of_other_texts_are_kept(spark):
    texts = ["one two three four five six seven", "alpha beta gamma delta epsilon", "red green blue yellow black white", "x y z x y z a b c"]
    rows = [(7, texts[0], "k"), (7, texts[1], "k"), (7, texts[0], "k"), (None, texts[2], "k"), (None, texts[0], "k"), (-3, texts[3], "k"), (None, texts[3], "z"), (9, texts[3], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text, r._row) for r in kept.collect()), key=str) == sorted([(7, texts[0], "k"), (7, texts[1], "k"), (None, texts[2], "k"), (-3, texts[3], "k")], key=str)


def test_tally_of_postings_against_plain_counts(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng, fps, lists, keys = random.Random(9), [], [], []
    for n, t in enumerate(simhash.TRIPLES * 2):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            x = base
            for p in range(8):
                if p not in t and rng.random() < 0.6:
                    x = x & ~(255 << 8 * p) | rng.choice([1, 2, 3]) << 8 * p
            fps.append(x)
            lists.append(n)
            keys.append((n % 8) << 24)
    u, tallied = np.array(fps, dtype=np.uint64), []
    monkeypatch.setattr(simhash, "BITS", -1)  # nothing gets connected, so every pair is tallied
    simhash.forest(u, np.array(lists), np.array(keys), lambda pairs: tallied.extend(pairs.tolist()))
    got = {(p // len(u), p % len(u)) for p in tallied}
    byte = lambda x: [x >> 8 * p & 255 for p in range(8)]
    want = {(i, j) for j in range(len(fps)) for i in range(j) if lists[i] == lists[j] and sum(a == b for a, b in zip(byte(fps[i]), byte(fps[j]))) >= 5}
    assert {tuple(sorted(p)) for p in got} == want and len(tallied) == len(want)


def test_large_dense_lists_stay_small(monkeypatch):
    """Lists of near copies: the forest connects what all pairs would."""
    rng, base = random.Random(4), 0x0123456789ABCDEF
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 3))) for _ in range(1500)})
    u = np.array(fps, dtype=np.uint64)
    near = [(i, j) for i in range(len(u)) for j in (np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 3) + i + 1).tolist()]
    monkeypatch.setattr(simhash, "TRIPLES", ((5, 6, 7),))
    monkeypatch.setattr(simhash, "OTHERS", np.array([[0, 1, 2, 3, 4]]))
    found = simhash.forest(u, np.zeros(len(u), dtype=np.int64), np.zeros(len(u), dtype=np.int64)).tolist()
    assert roots_of(range(len(u)), found) == roots_of(range(len(u)), near)
