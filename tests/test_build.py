"""Models and chains, dataset quotas, message logs, metadata, event streams and vector cells."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.functions import metadata
from orderloom.operators import datasets, metrics, models, retrieval, vector_index
from orderloom.plans import build_queries
from orderloom.plans.base import Tables
from orderloom.streaming import protocol

SF = "/root/testdata/sf0.01"


def test_only_undecided_rows_go_on_and_models_load_once_a_worker(spark, tmp_path):
    log = str(tmp_path)

    def stage(name, decides, least=0.0):
        def load():
            open(f"{log}/load-{name}-{os.getpid()}-{random.random()}", "w").close()
            return decides

        def predict(model, texts):
            with open(f"{log}/rows-{name}-{os.getpid()}", "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return [model(t) for t in texts]

        return models.Stage(name, models.labeler(f"{log}-{name}", load, predict), ["a", "b"], least)

    stages = [stage("one", lambda t: ("a", 0.9) if int(t) % 2 else ("z", 1.0)), stage("two", lambda t: ("b", int(t) / 100) if int(t) % 3 else (None, None), 0.5)]
    rows = spark.createDataFrame([(str(i), "x") for i in range(100)] + [(None, "x")], "text string, label string").repartition(8)
    found = {r.text: (r.label, r.stage) for r in models.chain(rows, "text", stages, "none").collect()}
    for i in range(100):
        assert found[str(i)] == (("a", "one") if i % 2 else ("b", "two") if i % 3 and i >= 50 else ("none", "fallback"))
    assert found[None] == ("none", "fallback")
    told = lambda name: sorted(int(x) for f in os.listdir(log) if f.startswith(f"rows-{name}-") for x in open(f"{log}/{f}").read().split())
    assert told("one") == list(range(100)) and told("two") == list(range(0, 100, 2))
    for name in ("one", "two"):
        pids = [f.split("-")[2] for f in os.listdir(log) if f.startswith(f"load-{name}-")]
        assert 1 <= len(pids) == len(set(pids))


def test_scorer_and_embedder_pass_nulls_by(spark):
    score = models.scorer("len", lambda: 2, lambda m, q, p: [m * len(a) + len(b) for a, b in zip(q, p)])
    embed = models.embedder("chars", lambda: 1.0, lambda m, texts: [[m * len(t)] for t in texts])
    df = spark.createDataFrame([("a", "bb"), (None, "b"), ("a", None)], "q string, p string")
    assert [(r.s, r.e) for r in df.select(score(F.col("q"), F.col("p")).alias("s"), embed(F.col("q")).alias("e")).collect()] == [(4.0, [1.0]), (None, None), (None, [1.0])]


def test_quotas_are_filled_exactly(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["order", "faq"]), rng.choice(["vi", "en"]), f" Text  {rng.randint(0, 60)}") for i in range(300)] + [(900, "rare", "vi", "one"), (901, "rare", "vi", "ONE "), (902, "rare", "vi", None), (903, "other", "vi", "x")]
    quotas = {("order", "vi"): 7, ("order", "en"): 3, ("faq", "vi"): 0, ("faq", "en"): 40, ("rare", "vi"): 5, ("none", "vi"): 2}
    c = spark.createDataFrame(rows, "id long, intent string, language string, text string")
    fill = lambda df: [(r.sample_id, r.intent, r.language, r.text) for r in datasets.fill(df, datasets.quota_table(spark, quotas), F.md5(F.col("id").cast("string"))).collect()]
    found = fill(c)
    count = {k: sum(f[1:3] == k for f in found) for k in quotas}
    assert count == {**quotas, ("none", "vi"): 0}
    assert len({" ".join(f[3].split()).lower() for f in found}) == len(found)
    assert sorted(found) == sorted(fill(c.repartition(7)))
    assert sorted(f[3] for f in found if f[1] == "rare")[1:] == [f"{sorted(f[3] for f in found if f[1] == 'rare')[0]} #{k}" for k in (2, 3, 4, 5)]
    assert fill(c.limit(0)) == []
    assert datasets.shares_of(10, {"vi": 0.7, "en": 0.3}) == {"vi": 7, "en": 3} and sum(datasets.shares_of(11, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).values()) == 11


def brute_messages(log):
    gone = {}
    for s, _, v, _, op, _ in log:
        if op == "drop":
            gone[s] = max(gone.get(s, v), v)
    best, appended = {}, set()
    for s, m, v, q, op, body in log:
        if op != "drop" and v > gone.get(s, -1):
            best[s, m] = max(best.get((s, m), (-1,)), (v, q, op, body))
            appended |= {(s, m)} if op == "append" else set()
    return sorted((*k, *b) for k, b in best.items() if b[2] != "delete" and k in appended)


def test_message_logs_and_their_compaction(spark):
    rng = random.Random(6)
    log = [(rng.randint(0, 4), rng.randint(0, 9), rng.randint(0, 30), q, rng.choice(["append", "append", "update", "update", "delete", "drop"] if rng.random() < 0.2 else ["append", "update", "delete"]), f"b{q}") for q in range(400)]
    schema = "session long, message long, version long, seq long, op string, body string"
    keys = ["session", "message"]
    bodies = lambda df: sorted((r.session, r.message, r.version, r.seq, r.body) for r in datasets.compact_messages(df, keys).collect())
    df = spark.createDataFrame(log, schema)
    want = [(s, m, v, q, b) for s, m, v, q, _, b in brute_messages(log)]
    assert bodies(df) == want and len(want) > 5
    small = datasets.compact_log(df, keys, 0)
    assert small.columns == df.columns and small.count() < len(log) / 2 and bodies(small) == want
    late = spark.createDataFrame([(1, 3, 2, 999, "append", "late"), (2, 2, 31, 1000, "update", "new"), (3, 1, 40, 1001, "append", "again")], schema)
    assert bodies(small.unionByName(late)) == bodies(df.unionByName(late))
    tie = spark.createDataFrame([(1, 1, 5, 1, "append", "a"), (1, 1, 5, 3, "update", "c"), (1, 1, 5, 2, "update", "b"), (1, 2, 1, 4, "update", "never"), (1, 4, 1, 1, "append", "x"), (1, 4, 1, 2, "delete", None)], schema)
    assert bodies(tie) == [(1, 1, 5, 3, "c")]


def test_metadata_merges(spark):
    cases = [
        ('{"a":{"b":1,"c":{"d":2}},"e":[1]}', '{"a":{"c":{"f":3}},"e":[2]}', {"a": {"b": 1, "c": {"d": 2, "f": 3}}, "e": [2]}), ('{"a":{"b":1}}', '{"a":null}', {"a": None}), ('{"a":1}', '{"a":{"b":2}}', {"a": {"b": 2}}),
        ('{"a":{"b":2}}', '{"a":7}', {"a": 7}), (None, '{"é":1}', {"é": 1}), ('{"a":1}', None, {"a": 1}), ("{", '{"a":1}', {"a": 1}), ("[1]", "3", None), (None, None, None), ("{}", "{}", {}), ('{"a":1,"a":2}', "{}", {"a": 2}),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.j for r in df.select("i", metadata.merge_json(F.col("a"), F.col("b")).alias("j")).collect()}
    assert {i: j if j is None else json.loads(j) for i, j in got.items()} == {i: w for i, (_, _, w) in enumerate(cases)}
    assert got[4] == '{"é":1}'
    deep = '{"a":' * 400 + "1" + "}" * 400
    assert metadata.merged(json.loads(deep), json.loads(deep)) == json.loads(deep)
    hit = df.limit(1).select(metadata.hit_metadata(F.lit('{"tier":"exact"}'), F.lit('{"used":true}'), F.lit(None).cast("string"), F.lit('{"n":1}')).alias("j")).first().j
    assert json.loads(hit) == {"cache": {"tier": "exact", "paraphrase": {"used": True}}, "queue_stats": {"n": 1}}


class Splitter:
    def __init__(self):
        self.buffer = ""

    def push(self, text):
        self.buffer += text
        out = []
        while any(c in ",.?!;:。！？؛،" for c in self.buffer):
            at = next(i for i, c in enumerate(self.buffer) if c in ",.?!;:。！？؛،")
            while at < len(self.buffer) and self.buffer[at] in ",.?!;:。！？؛،":
                at += 1
            clause, self.buffer = self.buffer[:at].strip(), self.buffer[at:].lstrip()
            out += [clause] * (len(clause) >= 12)
        return out


def streamed(text, fails):
    words, s = (text or "").split(), Splitter()
    words = words if fails is None else words[:fails]
    out = [("METADATA", None)] * bool(words)
    for w in words:
        out += [("TOKEN", f"{w} "), *[("CLAUSE", c) for c in s.push(f"{w} ")]]
    out += [("ERROR", protocol.STREAM_ERROR)] * (fails is not None)
    return [*out, *[("CLAUSE", s.buffer.strip())] * bool(s.buffer.strip()), ("DONE", "[DONE]")]


def test_event_streams_against_a_token_by_token_run(spark):
    rng = random.Random(9)
    bits = ["word", "long-enough-word", ",", "...", "a.b", "x!?", "，", "؟", "1.5", "end."]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), rng.choice([None, None, 0, 3, 99])) for i in range(150)] + [(900, None, None), (901, "", 0), (902, " \n ", None)]
    df = spark.createDataFrame(rows, "id long, text string, fails_at int").withColumns({"started": F.lit(1.0), "first_at": F.lit(1.5)})
    found = {}
    for r in protocol.answer_events(df, ["id"]).orderBy("id", "n").collect():
        found.setdefault(r.id, []).append((r.event, None if r.event == "METADATA" else r.data))
        assert r.n == len(found[r.id]) - 1 and (r.event != "METADATA" or float(r.data) == 500.0)
    assert found == {i: streamed(t, f) for i, t, f in rows}


def test_extraction_metrics_of_hard_rows_and_of_none(spark):
    rows = [('{"intent":"order","k":"Tea  #3"}', True, "order", "tea"), ('{"intent":"order"}', False, "order", ""), ('{"intent":"nope","k":1}', None, "nope", "1"), ("x", True, "order", None), (None, False, "order", None), ('go {"intent":"faq","k":null} on', False, "faq", "")]
    df = spark.createDataFrame(rows, "raw string, hard boolean, want_intent string, want_k string")
    run = lambda d: {(r.slice, r.metric): (r.n, r.value) for r in metrics.field_matches(d, ["intent", "k"], ["intent"], {"intent": ["order", "faq"]}).collect()}
    got = run(df)
    assert got["all", "parse_rate"] == (6, 0.6667) and got["all", "valid_rate"] == (6, 0.3333) and got["all", "all_fields"] == (6, 0.3333) and got["hard", "cache_relevant"] == (2, 0.5)
    assert set(run(df.limit(0)).values()) == {(0, 0.0)}


def test_vector_cells_find_nearly_all_and_fall_back(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    nodes = [(int(i), "document", f"t{i}", (centres[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)] + [(9000, "document", "none", None), (9001, "document", "zero", [0.0] * 16), (9002, "document", "short", [1.0, 2.0]), (9003, "document", "short", [2.0, 1.0])]
    n = spark.createDataFrame(nodes, "source_id long, source_type string, text string, embedding array<double>")
    q = spark.createDataFrame([(i, "faq", nodes[i][3]) for i in range(0, 3000, 20)] + [(9002, "faq", [1.0, 2.0])], "query_id long, intent string, embedding array<double>")
    index = vector_index.build(n)
    assert len(index.centroids) == 55 and index.nodes.where("cell IS NULL").count() == 4
    exact = retrieval.vector_hits(q, n, 10)
    told = vector_index.recall(vector_index.search(q, index, 10), exact).first()
    assert 1 <= index.probes <= 20
    assert told.queries == 151 and told.found >= 0.9 * told.wanted
    every = vector_index.search(q, index, 10, probes=55, block=100)
    rows = lambda df: sorted((r.query_id, r.source_id, round(r.score, 9)) for r in df.collect())
    assert rows(every) == rows(exact)
    few = vector_index.search(q, index, 10, probes=1, exact_below=1_000)
    assert rows(few) == rows(exact)
    assert [r.source_id for r in vector_index.search(q.where("query_id = 9002"), index, 10).orderBy(F.desc("score")).collect()] == [9002, 9003]
    assert vector_index.build(n.limit(0)).nodes.count() == 0 and vector_index.search(q, vector_index.build(n.limit(0)), 5).count() == 0
    again = vector_index.build(n.repartition(5))
    assert np.array_equal(again.centroids, index.centroids)


def test_vector_cells_of_the_tables(spark):
    r = build_queries.vector_cells_recall(Tables(spark, SF)).first()
    assert r.wanted > 0 and r.recall >= 0.9


def test_refreshed_nodes_are_embedded_by_a_model(spark):
    embed = models.embedder("bag", lambda: 8, lambda n, texts: [np.bincount([len(w) % n for w in t.split()] or [0], minlength=n).tolist() for t in texts])
    df = spark.createDataFrame([("a", "one two three"), ("b", None)], "source_id string, text string").withColumn("embedding", embed(F.col("text")))
    assert {r.source_id: r.embedding and sum(r.embedding) for r in df.collect()} == {"a": 3.0, "b": None}


def test_fallback_answers_and_carts_as_text(spark):
    from orderloom.functions import answers

    df = spark.createDataFrame([(1, [(2, "Trà", "M", 45000), (1, "Bánh", None, 30000)])], "i int, lines array<struct<quantity:int,item:string,size:string,price:int>>")
    r = df.select(answers.checkout_answer(F.col("lines")).alias("c"), answers.cart_updated(F.lit("Dạ."), F.filter("lines", lambda x: F.lit(False))).alias("u"), answers.faq_fallback(F.lit(None).cast("string")).alias("f")).first()
    assert r.c == f"{answers.CHECKOUT_HEAD}• 2 Trà size M — 90.000đ\n• 1 Bánh — 30.000đ\n**Tổng cộng: 120.000đ**{answers.CHECKOUT_END}"
    assert r.u == f"Dạ.{answers.CART_HEAD}\n**Tạm tính: 0đ**{answers.CART_END}" and r.f == answers.NO_FACT
    items = spark.createDataFrame([([("A", [("S", 1000)], "A — nice. More"), ("B", [], ""), ("C", [("S", 1000), ("M", 2000)], "")],)], "items array<struct<name:string,variants:array<struct<size:string,price:int>>,description:string>>")
    got = items.select(answers.consultant_fallback(F.col("items"), F.lit("x")).alias("a"), answers.consultant_fallback(F.lit(None).cast(items.schema["items"].dataType), F.lit("x")).alias("b"), answers.consultant_fallback(F.col("items"), F.lit("")).alias("c")).first()
    assert got.a.startswith(answers.ADVICE_HEAD + "• **A** — nice") and "**B**" not in got.a and "• **C**\n   S 1.000đ · M 2.000đ" in got.a
    assert got.b == answers.FOUND_HEAD + "x" + answers.FOUND_END and got.c == answers.NO_ADVICE
