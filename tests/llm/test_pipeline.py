"""run() against the same stages over plain Python rows."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import zstandard

import corpus_pipeline
from orderloom.llm import _shared, byte_bpe, mixing, quality, secret_scan, simhash

SF = "/root/testdata/sf0.001"


def pyhash(doc_id, text):
    return int(hashlib.md5(f"{'' if doc_id is None else doc_id}|{text}".encode()).hexdigest()[:15], 16)


def redacted(docs):
    """Base spans whose value few sources and documents hold and that looks random are masked."""
    found = {}
    for n, (i, t, s) in enumerate(docs):
        spans = [(m.start(), m.end(), m[2]) for m in re.finditer(secret_scan.ASSIGN, t) if len(m[2]) >= 6]
        spans += [(*m.span(), m[0]) for m in re.finditer("AKIA[A-Z0-9]{16,}", t)] + [(*m.span(), m[0]) for m in re.finditer("[0-9a-f]{24,}", t)]
        found[n] = sorted(spans)
    owners, repositories = {}, {}
    for n, (i, _, s) in enumerate(docs):
        for *_, v in found[n]:
            owners.setdefault(v, set()).add(s)
            repositories.setdefault(v, set()).add((s, i))
    few = lambda v: len(owners[v]) < secret_scan.COPIED_OWNERS and len(repositories[v]) < secret_scan.COPIED_REPOSITORIES
    random_looking = lambda v: len(set(v)) >= 10 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not re.search("[a-z]{12}|[A-Z]{16}", v)
    out = []
    for n, (i, t, s) in enumerate(docs):
        parts, at = [], 0
        for a, b, v in found[n]:
            if few(v) and random_looking(v):
                if a >= at:
                    parts += [t[at:a], "[SECRET]"]
                at = max(at, b)
        out.append((i, "".join(parts) + t[at:], s))
    return out


def mixed(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    names = sorted({s for *_, s in docs})
    total = {s: sum(size(t) for _, t, x in docs if x == s) for s in names}
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in over]
    out = []
    for s in names:
        whole, rest = divmod(int(target[s] + 1e-6), total[s])
        for _, i, t in sorted((pyhash(i, t), i, t) for i, t, x in docs if x == s):
            more = min(size(t), max(rest, 0))
            rest -= size(t)
            out += [(i, t)] * (whole + (2 * more >= size(t) and more > 0))
    return out


def brute_run(docs):
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    docs = [d for d in docs if quality.judge(d[1], compress)[-1]]
    fp = [simhash.fingerprint(t) % (1 << 64) for _, t, _ in docs]
    root = {}
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i)):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                root[x] = i
                todo += [j for j in range(len(docs)) if j not in root and (fp[x] ^ fp[j]).bit_count() <= 3]
    docs = mixed(redacted([d for i, d in enumerate(docs) if root[i] == i]))
    codec = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    return Counter((i, len(p := codec.encode(t)) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)


def test_run_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == brute_run(docs)


def test_stages_keep_columns_and_bear_empty_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.limit(0), SF).columns == df.columns, name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], df.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()


def test_last_cut_is_whole(spark):
    assert [c for c in mixing.mix_documents(spark.read.parquet(f"{SF}/documents.parquet")).columns] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_scratch_tables_are_deleted_but_for_those_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_shared, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    there = lambda: [p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").iterdir()]
    with _shared.scratch(spark):
        first = _shared.materialize(spark.range(3), "first")
        kept = _shared.keep(_shared.materialize(first.selectExpr("id + 1 as id"), "second"))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3] and there() == ["second"]
    _shared.remove(spark, kept)
    assert there() == []
    assert corpus_pipeline.run(spark, SF).count() > 0 and there() == ["stage-mix"]


def test_repeated_ids_with_other_texts(spark, tmp_path):
    """Rows that share an id but no text all go through the stages as rows of their own."""
    rng = __import__("random").Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    rows = [(i % 40, " ".join(word() for _ in range(rng.randint(60, 200))), "en", f"s{i % 3}", 1) for i in range(120)] + [(None, None, "en", "s1", 1), (1, "", "en", None, 0)]
    rows += [rows[0], rows[0], (999, rows[1][1], "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == brute_run([(i, t or "", s) for i, t, _, s, _ in rows])


def test_scratch_blocks_of_two_threads_are_apart(spark, tmp_path, monkeypatch):
    import threading

    monkeypatch.setattr(_shared, "shared_dir", lambda spark: str(tmp_path))
    opened, closed, seen = threading.Event(), threading.Event(), {}

    def other():
        with _shared.scratch(spark):
            seen["theirs"] = _shared.materialize(spark.range(3), "theirs")
            opened.set()
            closed.wait(60)
            seen["n"] = seen["theirs"].count()

    with _shared.scratch(spark):
        mine = _shared.materialize(spark.range(2), "mine")
        thread = threading.Thread(target=other)
        thread.start()
        opened.wait(60)
        assert mine.count() == 2
    closed.set()
    thread.join()
    assert seen["n"] == 3 and not list(tmp_path.iterdir())
    alone = _shared.materialize(spark.range(1), "alone")
    _shared.remove(spark, alone)
    assert not list(tmp_path.iterdir())


def test_a_query_inside_a_scratch_block_leaves_nothing(spark, tmp_path, monkeypatch):
    from orderloom.llm import registry

    monkeypatch.setattr(_shared, "shared_dir", lambda spark: str(tmp_path))
    for name in ("op3_url_filter", "op11_bottom_k", "op12_spelling_variants", "op13_prefix_trie"):
        with _shared.scratch(spark):
            assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        assert not list(tmp_path.iterdir()), name
