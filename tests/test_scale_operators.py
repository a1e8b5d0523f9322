"""Joins by rare runs, blocks and parts, and folds over batches, against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx
from orderloom.operators import metrics, quantiles, ranks, retrieval, substrings
from orderloom.streaming import sessions


def some_text(rng, n):
    return "".join(rng.choice("ab cé\U0001f600") for _ in range(rng.randint(0, n)))


def test_holding_against_all_pairs(spark):
    rng = random.Random(1)
    texts = [(i, [some_text(rng, 30) for _ in range(rng.randint(0, 3))] + [None] * rng.randint(0, 1)) for i in range(120)] + [(500, None), (501, [])]
    needles = sorted({some_text(rng, 5) for _ in range(60)} | {"", "a", "ab", "\U0001f600é"})
    df = spark.createDataFrame(texts, "id long, fields array<string>")
    asked = spark.createDataFrame([(n,) for n in [*needles, needles[3], None]], "term string")
    got = Counter((r.id, r.term) for r in substrings.holding(df, "id", "fields", asked, "term").collect())
    want = {(i, n) for i, fs in texts if fs is not None for n in needles if n == "" or any(n in f for f in fs if f is not None)}
    assert set(got) - {(i, "") for i, _ in texts} == {w for w in want if w[1]} and max(got.values()) == 1
    assert {i for i, n in got if n == ""} == {i for i, fs in texts if fs and any(f is not None for f in fs)}
    assert substrings.holding(df, "id", "fields", asked.limit(0), "term").count() == 0


def some_groups(kind, n=4000):
    """Groups of which one holds most rows, and in it one value holds half; kind: the values beside it."""
    rng = random.Random(2)
    beside = {"wide": lambda: rng.choice([-1e300, -3.5, rng.random(), 10 ** rng.uniform(-300, 300)]), "close": lambda: 7 + rng.randint(0, 5) * 1e-12, "steps": lambda: float(rng.randint(0, 60))}[kind]
    return [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([7.0, beside(), None if rng.random() < 0.1 else beside()])) for _ in range(n)] + [("one", 5.0), ("none", None)]


@pytest.mark.parametrize("kind, in_hand", [("wide", 20), ("close", 5), ("steps", 1), ("steps", 100_000)])
def test_values_at_ranks_against_sorting(spark, kind, in_hand):
    rows = some_groups(kind)
    df = spark.createDataFrame(rows, "k string, v double")
    n = F.col("n")
    wanted = {"first": F.lit(1), "mid": F.floor((n + 1) / 2), "late": F.floor(n * 0.97), "last": n, "out": n + 1}
    got = {r.k: r for r in quantiles.values_at(df, "v", wanted, "k", in_hand=in_hand).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert got.keys() == by.keys()
    for k, vs in by.items():
        vs, r = sorted(vs), got[k]
        at = lambda i: vs[i - 1] if 1 <= i <= len(vs) else None
        assert (r.n, r["first"], r.mid, r.late, r["last"], r.out) == (len(vs), at(1), at((len(vs) + 1) // 2), at(int(len(vs) * 0.97)), at(len(vs)), None), k
    whole = quantiles.values_at(df, "v", {"mid": F.floor((n + 1) / 2)}, in_hand=in_hand).first()
    every = sorted(v for _, v in rows if v is not None)
    assert whole.mid == every[(len(every) + 1) // 2 - 1]
    assert quantiles.values_at(df.limit(0), "v", wanted, "k").count() == 0


@pytest.mark.parametrize("in_hand", [1, 7, 100_000])
def test_splits_and_digests_against_sorting(spark, in_hand):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), f"{rng.choice([1, rng.getrandbits(32)]):08x}", i) for i in range(900)] + [("one", "00000000", 1000)]
    df = spark.createDataFrame(rows, "k string, d string, i int")
    got = {r.k: r for r in quantiles.digests_at(df, "d", "i", {"cut": F.floor(F.col("n") * 0.8)}, "k", in_hand=in_hand).collect()}
    by = {}
    for k, d, i in rows:
        by.setdefault(k, []).append((d, i))
    for k, own in by.items():
        at = int(len(own) * 0.8)
        assert (got[k].cut and tuple(got[k].cut)) == (sorted(own)[at - 1] if at else None)
    parts = {(r.k, r.i): r.split for r in metrics.split(df.withColumn("split", F.lit("old")), "k", F.col("d"), "i").collect()}
    for k, own in by.items():
        told = [parts[k, i] for _, i in sorted(own)]
        assert told == ["train"] * int(len(own) * 0.8) + ["validation"] * int(len(own) * 0.1) + ["test"] * (len(own) - int(len(own) * 0.8) - int(len(own) * 0.1))


def test_chains_in_ranges_of_bounded_size(spark):
    rng = random.Random(6)
    keys = rng.sample(range(10**6), 1500)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None])) for k in keys]
    df = spark.createDataFrame(rows, "id long, doc string")
    found = ranks.chained(df, "id", ["doc"], "next", in_range=100).collect()
    by = {}
    for k, doc in sorted(rows):
        by.setdefault(doc, []).append(k)
    assert sorted((str(r.doc), r.id, r["next"] or -1) for r in found) == sorted((str(d), a, b) for d, ks in by.items() for a, b in zip(ks, [*ks[1:], -1]))
    assert ranks.chained(df.limit(0), "id", [], "next").count() == 0


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    q, d = [(i, some(8)) for i in range(40)] + [(99, None)], [(i, some(15)) for i in range(120)] + [(999, None), (998, "")]
    queries, texts = spark.createDataFrame(q, "q long, text string"), spark.createDataFrame(d, "d long, text string")
    for least in (0.3, 0.5, 1.0):
        got = sorted((r.q, r.d, round(r.overlap, 9)) for r in retrieval.overlaps(queries, "q", texts, "d", least).collect())
        share = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()))
        assert got == sorted((i, j, round(share(a, b), 9)) for i, a in q if a for j, b in d if b and share(a, b) >= least)


def test_terms_meet_the_first_nodes_of_each_fields_only(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"menu_{i:03}", "menu", ["red bolt", "blue bolt", "red ring"][i % 3], f"t{i}") for i in range(300)], "source_id string, source_type string, name string, text string")
    queries = spark.createDataFrame([(1, "order", "bolt"), (2, "order", "red")], "query_id long, intent string, text string")
    cuts, plain = [], retrieval.top

    def top(hits, k, by=None, within=("query_id",)):
        cuts.append((within, hits.count()))
        return plain(hits, k, by, within)

    monkeypatch.setattr(retrieval, "top", top)
    found = retrieval.keyword_hits(queries, nodes.withColumn("fields", F.array("name")), 5).collect()
    want = {(q, f"menu_{i:03}") for q, kinds in ((1, (0, 1)), (2, (0, 2))) for i in [i for i in range(300) if i % 3 in kinds][:5]}
    assert {(r.query_id, r.source_id) for r in found} == want and len(found) == 10
    assert dict(cuts)["term", "source_type"] == 4 * 5  # terms and fields that hold them, five nodes each, not all 400 pairs with nodes


def test_overlaps_read_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: read.add(1) or t, "string").asNondeterministic()
    texts = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 5} beta") for i in range(60)], "d long, text string").withColumn("text", seen("text"))
    queries = spark.createDataFrame([(i, f"w{i} beta gamma") for i in range(7)], "q long, text string")
    found = retrieval.overlaps(queries, "q", texts, "d", 0.5).collect()
    assert sorted((r.q, r.d) for r in found) == sorted((q, d) for q in range(7) for d in range(60) if q in (d % 7, d % 5))
    assert read.value == 60


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(4)
    vec = {i: rng.standard_normal(6).tolist() for i in range(150)} | {200: [0.0] * 6, 201: [], 202: None, 203: rng.standard_normal(3).tolist()}
    vec[151] = vec[7]
    kind = lambda i: ["menu", "faq", "document"][i % 3]
    intent = lambda i: ["order", "consultant", "faq", "ignore"][i % 4]
    nodes = spark.createDataFrame([(i, kind(i), f"t{i}", v) for i, v in vec.items()], "source_id long, source_type string, text string, embedding array<double>")
    queries = spark.createDataFrame([(i, intent(i), v) for i, v in vec.items() if i % 5 == 0 or i > 199], "query_id long, intent string, embedding array<double>")

    def cosine(a, b):
        return None if not a or not b or len(a) != len(b) or not any(a) or not any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    want = []
    for q in (i for i in vec if i % 5 == 0 or i > 199):
        for k in retrieval.VECTOR_TYPES.get(intent(q), []):
            found = [(round(-s, 9), i) for i, v in vec.items() if kind(i) == k and (s := cosine(vec[q], v)) is not None and s >= 0.05]
            want += [(q, i, round(-s, 6)) for s, i in sorted(found)[:4]]
    for block in (10, 5000):
        got = sorted((r.query_id, r.source_id, round(r.score, 6)) for r in retrieval.vector_hits(queries, nodes, 4, 0.05, block).collect())
        assert got == sorted(want)
    rows = spark.createDataFrame([(i, i % 2, v) for i, v in vec.items()], "id long, label int, embedding array<double>")
    best = {r.id: (r.entry, round(r.similarity, 6)) for r in retrieval.nearest_of_label(rows.where("id % 5 = 0"), rows, "id", "label").collect()}
    for q in (i for i in vec if i % 5 == 0):
        found = [(round(-s, 9), i) for i, v in vec.items() if i != q and i % 2 == q % 2 and (s := cosine(vec[q], v)) is not None]
        assert best.get(q) == ((min(found)[1], round(-min(found)[0], 6)) if found else None)


def test_neighbours_by_type(spark):
    nodes = [(f"d{i}", "document", f"chunk {i}", None) for i in range(6)] + [(f"m{i}", "menu", f"item {i}", "tea" if i < 8 else "cake") for i in range(9)]
    nodes += [("f1", "faq", "wifi?", None), ("e1", "entity", "Entity: wifi", None), ("e2", "entity", "Entity: open", None)]
    edges = [(f"d{i}", "NEXT", f"d{i + 1}") for i in range(5)] + [("f1", "MENTIONS", "e1"), ("d2", "MENTIONS", "e2"), ("d2", "MENTIONS", "d2"), ("m0", "MENTIONS", "e1"), ("f1", "NEXT", "d0")]
    n = spark.createDataFrame(nodes, "source_id string, source_type string, text string, category string")
    e = spark.createDataFrame(edges, "source_id string, relation string, target_id string")
    hits = spark.createDataFrame([(1, "faq", s, k, t, 1.0) for s, k, t, _ in nodes if s in ("d2", "m0", "m8", "f1", "e1")], "query_id int, intent string, source_id string, source_type string, text string, score double")
    got = sorted((r.source_id, r.expanded, round(r.score, 6)) for r in retrieval.expand_by_type(hits, e, n).collect())
    near, kin = round(lx.EXPANSION_WEIGHT * lx.ENTITY_FACTOR, 6), round(lx.EXPANSION_WEIGHT * lx.CATEGORY_FACTOR, 6)
    own = [(s, False, 1.0) for s in ("d2", "m0", "m8", "f1", "e1")]
    assert got == sorted([*own, ("d1", True, near), ("d3", True, near), ("e2", True, near), ("e1", True, near), *[(f"m{i}", True, kin) for i in range(1, 6)]])


def test_unknown_modes_are_keyword_search(spark):
    q = spark.createDataFrame([(1, "order", "green tea")], "query_id int, intent string, text string").withColumn("embedding", tx.hash_vector(tx.tokens(F.col("text")), 16))
    n = spark.createDataFrame([("a", "menu", "Green tea", "green tea", ["green tea"], "tea", None), ("b", "menu", "Mocha", "mocha", ["mocha"], "coffee", None)], "source_id string, source_type string, name string, text string, fields array<string>, category string, topic string")
    n = n.withColumn("embedding", tx.hash_vector(tx.tokens(F.col("text")), 16))
    e = spark.createDataFrame([], "source_id string, relation string, target_id string")
    found = {m: sorted(r.source_id for r in retrieval.retrieve_auto(m, q, n, e).collect()) for m in ("keyword", "nonsense", "vector", "hybrid", "hybrid_graph")}
    assert found["keyword"] == found["nonsense"] == ["a"] and all("a" in v for v in found.values())


def test_hash_vectors(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "w array<string>").select(tx.hash_vector(F.col("w"), 32).alias("v"), tx.hash_vector(F.col("w"), 32, False).alias("n")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-9 and sum(rows[0].n) == 3 and rows[1].v is None and rows[2].v is None


def test_clauses_against_a_plain_pattern(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "longer words ", ".", "!?", ", ", "\n", " ", "。"]) for _ in range(rng.randint(0, 20))) for _ in range(200)] + ["", "x" * 3_000, "a." * 20_000, " . " * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    marks = "[,.?!;:。！？؛،]"
    for r in df.select("i", tx.clauses(F.col("t")).alias("c")).collect():
        t = texts[r.i]
        kept = [x for m in re.finditer(f"(?s)[^{marks[1:-1]}]*{marks}+", t) if len(x := m[0].strip()) >= lx.CLAUSE_MIN]
        rest = re.sub(f"(?s)^.*{marks}", "", t).strip()
        assert r.c == kept + [rest] * (rest != "")


def replay(log, ttl, size):
    """Two tiers by plain lists."""
    exact, near, out = {}, {}, []
    for r in sorted(log, key=lambda r: r["seq"]):
        i, now = r["intent"], r["seconds"]
        x, s = exact.setdefault(i, []), near.setdefault(i, [])
        if r["op"] == "clear":
            x.clear()
            s.clear()
            out.append((r["seq"], "cleared", None, False))
            continue
        if i not in lx.CACHEABLE:
            out.append((r["seq"], "skipped", None, False))
            continue
        storable = bool((r["answer"] or "").strip())
        tags = set(r["tags"]) if i == "faq" and set(r["tags"]) <= set(lx.FAQ_ALIAS_TAGS) else set()
        v = np.array(r["embedding"], dtype=np.float32)
        v = v / np.linalg.norm(v)

        def store():
            for e in s:
                if e[0] == r["text"]:
                    e[1:] = [now + ttl, v, tags]
                    return
            s.append([r["text"], now + ttl, v, tags])
            del s[:-size]

        x[:] = [e for e in x if not (e[0] == r["key"] and e[1] <= now)]
        if hit := [e for e in x if e[0] == r["key"]]:
            x.remove(hit[0])
            x.append(hit[0])
            if storable:
                store()
            out.append((r["seq"], "exact", r["key"], storable))
            continue
        s[:] = [e for e in s if e[1] > now]
        near_ = [float(e[2] @ v) for e in s]
        best = int(np.argmax(near_)) if near_ else -1
        if best >= 0 and near_[best] >= lx.SEMANTIC_THRESHOLDS.get(i, lx.SEMANTIC_DEFAULT):
            out.append((r["seq"], "semantic", s[best][0], False))
        elif best >= 0 and tags and s[best][3] == tags:
            out.append((r["seq"], "alias", s[best][0], False))
        else:
            if storable:
                x.append([r["key"], now + ttl])
                del x[:-size]
                store()
            out.append((r["seq"], "miss", None, storable))
    return sorted(out)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_two_tiers_against_plain_lists(spark, batch):
    rng, base = random.Random(6), np.random.default_rng(6).standard_normal((14, 5))
    log = []
    for n in range(600):
        k = rng.randrange(14)
        log.append({
            "intent": rng.choice(["faq", "faq", "consultant", "ignore", "order", "other"]), "seq": n, "seconds": 10.0 * n, "op": "clear" if rng.random() < 0.01 else None, "key": f"k{k}{rng.choice('ab')}",
            "text": f"t{k}{rng.choice('abc')}", "answer": rng.choice(["yes", "yes", " ", None]), "embedding": (base[k] + rng.choice([0.0, 0.3]) * np.random.default_rng(n).standard_normal(5)).tolist(),
            "tags": rng.choice([[], ["wifi"], ["payment", "wifi"], ["coffee"]]),
        })
    df = spark.createDataFrame(log, "intent string, seq long, seconds double, op string, key string, text string, answer string, embedding array<double>, tags array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = sessions.two_tier_cache(df.orderBy(F.rand(1)), ttl=900, size=6)
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = replay(log, 900, 6)
    assert sorted((r.seq, r.tier, r.matched, r.stored) for r in got) == want
    assert {w[1] for w in want} == {"exact", "semantic", "alias", "miss", "skipped", "cleared"}
    stats = {r.intent: r for r in sessions.cache_statistics(found).collect()}
    assert stats["order"].skipped and not stats["order"].asked
    assert sum(r.exact for r in stats.values()) == sum(w[1] == "exact" for w in want)
    assert sessions.two_tier_cache(df.limit(0)).count() == 0


def test_equal_queries_and_texts_are_met_once(spark):
    words = ["hot tea", "iced tea", "hot milk", "cold beer"]
    queries = spark.createDataFrame([(i, ["order", "faq", None][i % 3], words[i % 2] if i % 7 else None) for i in range(40)], "query_id long, intent string, text string")
    seen = []

    def search(q):
        seen.append(sorted((r.intent or "", r.text or "", r.query_id) for r in q.collect()))
        return q.select("query_id", F.lit("a").alias("source_id"))

    assert sorted(r.query_id for r in retrieval.each_once(queries, search).collect()) == list(range(40))
    assert len(seen[0]) == len({x[:2] for x in seen[0]}) == 9
    nodes = spark.createDataFrame([(f"n{i:03}", ["menu", "faq"][i % 2], words[i // 2 % 4] + " ?" * (i % 3)) for i in range(150)] + [("x", "menu", None)], "source_id string, source_type string, text string")
    vector = lambda df: df.withColumn("embedding", tx.hash_vector(tx.tokens(F.col("text")), 16))
    asked = queries.where("query_id < 6")
    rows = lambda df: sorted((r.query_id, r.source_id, r.text, round(r.score, 6)) for r in df.collect())
    assert rows(retrieval.text_hits(asked, nodes, vector, 5)) == rows(retrieval.vector_hits(vector(asked), vector(nodes), 5))
    modes = retrieval.retrieve_modes(["vector"], queries, nodes, None, 5, vector).where("query_id < 6")
    assert sorted((r.query_id, r.source_id) for r in modes.collect()) == [(q, i) for q, i, *_ in rows(retrieval.top(retrieval.vector_hits(vector(asked), vector(nodes)), 5))]


def test_cosines_at_once_are_bounded(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    table = lambda name, n: pa.table({name: range(n), "intent": ["faq"] * n, "source_type": ["faq"] * n, "embedding": rng.integers(-2, 3, (n, 4)).astype(float).tolist()})
    q, n, plain, sizes = table("query_id", 60), table("source_id", 90), retrieval.cosines, []
    want = retrieval.nearest_in_blocks(q, n, 7, 0.05)
    monkeypatch.setattr(retrieval, "COSINES_AT_ONCE", 200)
    monkeypatch.setattr(retrieval, "cosines", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    assert retrieval.nearest_in_blocks(q, n, 7, 0.05).sort_by([("query_id", "ascending"), ("source_id", "ascending")]).equals(want.sort_by([("query_id", "ascending"), ("source_id", "ascending")]))
    assert sizes and max(sizes) <= 200
    exact, best = plain(retrieval.matrix(q), retrieval.matrix(n)), {}
    for a, b in zip(want["query_id"].to_pylist(), want["source_id"].to_pylist()):
        best.setdefault(a, []).append(b)
    for a, scores in enumerate(np.round(exact, 9).tolist()):
        assert best.get(a, []) == [b for s, b in sorted((-s, b) for b, s in enumerate(scores) if np.isfinite(s) and s >= 0.05)[:7]]


def test_fusion_with_all_rows_of_a_label(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from orderloom.plans import base, catalog_queries  # noqa: F401

    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(4).tolist(), i % 2) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(base.SQL["hybrid_fusion"]).fetchall())
    got = sorted((r.query_id, r.source_id, r.score) for r in base.QUERIES["hybrid_fusion"](spark, str(tmp_path)).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    beyond = [x for x in got if x[1] % 2 == x[0] % 2 and x[1] >= 80 and x[2] > 0.225]  # near and of the label, though not among its first forty
    assert beyond


def test_summaries_carry_heads_of_messages_only(spark, monkeypatch):
    texts = [(1, i, "word %d " % i * (1 + 40 * (i % 9))) for i in range(60)] + [(2, 0, None)]
    rows, carried = spark.createDataFrame(texts, "session long, turn int, text string"), []
    plain = sessions.folded
    monkeypatch.setattr(sessions, "folded", lambda df, *rest: carried.append(df) or plain(df, *rest))
    got = {(r.session, r.turn): (r.kept, r.summary) for r in sessions.summaries(rows).collect()}
    history, summary = [], None
    for s, turn, text in texts[:-1]:
        history.append(text)
        if sum(max(1, len(t) // lx.CHARS_PER_TOKEN) for t in history) >= int(lx.CONTEXT_TOKENS * lx.SUMMARY_RATIO) and len(history) > lx.HISTORY_WINDOW:
            summary = "\n".join(history[: -lx.HISTORY_WINDOW])[: lx.SUMMARY_CHARS]
            del history[: -lx.HISTORY_WINDOW]
        assert got[s, turn] == (len(history), summary)
    assert summary and got[2, 0] == (1, None)
    assert carried[0].select(F.max(F.length("head"))).first()[0] <= lx.SUMMARY_CHARS
