import hashlib
import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from orderloom.llm import bottom_k

COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def brute_hashes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - 4) if w else 0)}


def brute_near(a, b):
    union = sorted(set(a) | set(b))[:128]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def brute_rows(docs):
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    key = lambda d: (d[0] is None, -(d[0] or 0), signed(d[1] or ""))
    order = sorted(set((i, t or "") for i, t in docs), key=key)
    after = {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    out = []
    for i, t in docs:
        t = t or ""
        n, nxt = len(t), after[(i, t)][1]
        edited = t[: n - n // 3] + nxt[: n // 3]
        own, other, follow = (sorted(brute_hashes(x))[:128] for x in (t, edited, nxt))
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(other), brute_near(own, other), brute_near(own, follow)))
    return sorted(map(str, out))


def texts(n=150, seed=6):
    rng = random.Random(seed)
    words = ["the", "The", "é", "\U0001f600", "word", "x\x1cy", "zz", " "]
    sep = [" ", "  ", "\n", "\t", "\r\n"]
    out = [(i * 3, "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 400])))) for i in range(n)]
    out += [(9, out[5][1]), (9, out[5][1]), (9, "another of one id"), (None, "no id " * 9), (None, None), (None, None), (-4, ""), (8, None)]
    out += [(2**40, " ".join(f"{rng.random()}" for _ in range(60_000))), (12, "a" * 400_000)]
    rng.shuffle(out)
    return out


def found(df):
    return sorted(str(tuple(r[c] for c in COLS)) for r in df.collect())


def test_query_against_brute_force(spark, tmp_path):
    docs = texts()
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, hash string, part int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(bottom_k.op11_bottom_k(spark, str(tmp_path))) == brute_rows(docs)


@pytest.mark.parametrize("docs", [[], [(5, "one two three four five six seven eight nine")], [(1, "a"), (1, "a")], [(1, None), (2, "some words here to lend " * 3)]])
def test_few_rows_and_sql(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = found(bottom_k.op11_bottom_k(spark, str(tmp_path)))
    assert rows == (brute_rows(docs) if docs else [])
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows == sorted(map(str, con.sql(f"select {', '.join(COLS)} from ({bottom_k.OP11_SQL})").fetchall()))


def test_ranges_of_any_number_follow_each_other(spark):
    rows = [(i,) for i in range(500)]
    random.Random(1).shuffle(rows)
    got = {r.n: r.next.n for r in bottom_k.followers(spark.createDataFrame(rows, "n long"), [F.col("n").desc()]).collect()}
    assert got == {i: (i - 1) % 500 for i in range(500)}


def test_estimates(spark):
    rng = random.Random(2)
    shared = [f"w{rng.randrange(10**9)}" for _ in range(6000)]
    a, b = shared + [f"a{i}" for i in range(6000)], shared + [f"b{i}" for i in range(2000)]
    df = spark.createDataFrame([("a", " ".join(a)), ("b", " ".join(b)), ("e", "")], "name string, text string")
    s = {r["name"]: r for r in bottom_k.with_sketch(df, k=512).withColumn("n", bottom_k.distinct_shingles(F.col("sketch"), 512)).collect()}
    assert abs(s["a"].n / len(brute_hashes(" ".join(a))) - 1) < 0.15 and s["e"].n == 0
    pair = spark.createDataFrame([(s["a"].sketch, s["b"].sketch, [])], "a array<string>, b array<string>, e array<string>")
    c = F.col
    got = pair.select(
        bottom_k.resemblance(c("a"), c("b"), 512), bottom_k.containment(c("b"), c("a"), 512), bottom_k.containment(c("e"), c("a"), 512),
        bottom_k.merged(c("a"), c("b"), 512), bottom_k.resemblance(c("e"), c("e")), bottom_k.containment(c("a"), c("a"), 512),
    ).first()
    assert abs(got[0] - 6 / 14) < 0.07 and abs(got[1] - 6 / 8) < 0.1 and got[2] == 1.0 and got[4] == 1.0 and got[5] == 1.0
    assert got[3] == sorted(brute_hashes(" ".join(a)) | brute_hashes(" ".join(b)))[:512]


def test_sketches_of_parts_merge(spark):
    docs = [(i, t, "hot" if i is None or i % 3 else "cold") for i, t in texts(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    got = {r.source: r.sketch for r in bottom_k.grouped(bottom_k.with_sketch(df), ["source"]).collect()}
    for source in ("hot", "cold"):
        assert got[source] == sorted(set().union(*[brute_hashes(t or "") for _, t, s in docs if s == source]))[:128]
