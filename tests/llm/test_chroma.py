import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orderloom.llm import chroma
from orderloom.llm.chroma import Sound

SMALL = Sound(frame=1024, hop=256)


def tune(seed, seconds=6.0, rate=11025):
    """Random notes as 16-bit samples."""
    rng, parts = random.Random(seed), []
    while sum(map(len, parts)) < seconds * rate:
        t = np.arange(int(rng.uniform(0.1, 0.4) * rate)) / rate
        f = [220 * 2 ** (rng.randint(0, 24) / 12) for _ in range(2)]
        parts.append(sum(np.sin(2 * np.pi * x * t) for x in f))
    return np.concatenate(parts)[: int(seconds * rate)]


def pcm(x, noise=0.0, seed=0):
    x = x + noise * np.random.default_rng(seed).standard_normal(len(x))
    return (x * 8000).astype("<i2").tobytes()


def test_chroma_finds_the_pitch_class():
    t = np.arange(11025) / 11025
    for semitone in range(12):
        rows = chroma.chroma(pcm(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t)), Sound())
        assert (rows.argmax(axis=1) == semitone).all()


def test_codes_against_plain_sums():
    media = pcm(tune(1), 0.1)
    frames = chroma.chroma(media, SMALL).astype(float)
    n, got = chroma.codes(media, SMALL)
    assert n == len(frames) and len(got) == n - chroma.WIDTH + 1
    for at in (0, 7, len(got) - 1):
        bits = ""
        for shape, p, h, w in chroma.FILTERS:
            area = frames[at : at + w, p : p + h]
            half, mid = (p + p + h) // 2 - p, max(1, w // 3)
            total = area.sum()
            if shape == 0:
                a, b = total, (frames[at : at + w].sum() - total) * h / (12 - h)
            else:
                a = {1: area[:, half:], 2: area[: w // 2], 4: area[:, h // 3 : h - h // 3], 5: area[mid : w - mid]}.get(shape, area[:0]).sum()
                a = area[: w // 2, :half].sum() + area[w // 2 :, half:].sum() if shape == 3 else a
                b = total - a
            r = np.log((0.01 + a) / (0.01 + b))
            bits += ["00", "01", "11", "10"][int(r >= -chroma.QUANTUM) + int(r >= 0) + int(r >= chroma.QUANTUM)]
        assert int(bits, 2) == int(got[at]) % (1 << 32)


def test_alignment_finds_the_offset_and_tells_tunes_apart():
    x = tune(2, 8)
    _, a = chroma.codes(pcm(x), SMALL)
    _, b = chroma.codes(pcm(x[SMALL.hop * 40 :], 0.02), SMALL)
    offset, votes, wrong = chroma.align(a, b)
    assert offset == 40 and wrong <= chroma.MAX_BIT_ERROR and votes > 20
    _, other = chroma.codes(pcm(tune(3, 8)), SMALL)
    assert chroma.align(a, other)[2] > 0.25
    assert chroma.align(a, a[:0].copy())[1:] == (0, 1.0)


def test_groups_against_all_pairs(spark):
    rows, truth = [], {}
    for t in range(8):
        x = tune(10 + t)
        for c in range(4):
            i = 10 * t + c
            truth[i] = 10 * t
            rows.append((i, bytearray(pcm(x[SMALL.hop * 3 * c :], 0.005 * c, i)), i))
    rows += [(900, bytearray(pcm(tune(10))), 0), (900, bytearray(pcm(tune(10))), 0), (901, None, 0), (902, bytearray(b""), 0), (903, bytearray(b"short"), 0), (904, bytearray(b"other"), 0), (905, bytearray(b"short"), 0), (None, bytearray(b"short"), 0), (906, bytearray(b""), 0), (None, None, 0)]
    truth |= {900: 0, 901: 901, 902: 902, 903: 903, 904: 904, 905: 903, 906: 902}
    df = spark.createDataFrame(rows, "media_id long, media binary, digest int")
    found = chroma.with_codes(df, "media", SMALL).select("media_id", F.sha2("media", 256).alias("media_digest"), "chroma.n_frames", "chroma.codes")
    got = chroma.group_recordings(found).collect()
    assert len(got) == len(rows)
    assert all(r.group_id == truth[r.media_id] for r in got if r.media_id is not None)
    assert chroma.group_recordings(found.limit(0)).count() == 0


def aligned(codes, i, j):
    """Whether recordings i < j align, by plain steps."""
    a, b = codes[i], codes[j]
    offset, votes, wrong = chroma.align(a, b)
    overlap = min(len(a), len(b) + offset) - max(0, offset)
    return votes and wrong <= chroma.MAX_BIT_ERROR and overlap >= max(chroma.MIN_OVERLAP, min(len(a), len(b)) / 2)


def roots(nodes, links):
    root = {i: i for i in nodes}
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_documents_groups_against_all_pairs(spark):
    """Every alignment of a query, and every equal copy, is in a group; and no group holds more than alignments join."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    codes = {r.doc_id: chroma.codes(r.text.encode(), chroma.TEXT_SOUND)[1] for r in docs}
    ids = sorted(codes)
    text = {r.doc_id: r.text for r in docs}
    equal = [(i, j) for n, j in enumerate(ids) for i in ids[:n] if text[i] == text[j] or len(codes[i]) and np.array_equal(codes[i], codes[j])]
    links = [(i, j) for n, j in enumerate(ids) for i in ids[:n] if len(codes[i]) and len(codes[j]) and aligned(codes, i, j)]
    group = {r.doc_id: r.group_id for r in chroma.op8_chroma_fingerprints(spark, sf).collect()}
    whole, asked = roots(ids, links + equal), [(i, j) for i, j in links if i % chroma.EVERY == 0 or j % chroma.EVERY == 0]
    assert asked and len(group) == len(docs)
    assert all(group[i] == group[j] for i, j in asked + equal)
    assert all(whole[i] == whole[g] and g <= i for i, g in group.items())
    rows = chroma.with_codes(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("media")), "media", chroma.TEXT_SOUND)
    rows = rows.select("doc_id", F.sha2("media", 256).alias("media_digest"), "chroma.n_frames", "chroma.codes")
    assert {r.doc_id: r.group_id for r in chroma.group_recordings(rows, "doc_id").collect()} == whole


def variants(n=5, copies=4):
    out = {}
    for t in range(n):
        x = tune(40 + t)
        for c in range(copies):
            out[10 * t + c] = chroma.codes(pcm(x[SMALL.hop * 5 * c :], 0.004 * c, c), SMALL)[1]
    out[900], out[901] = np.full(300, 7, dtype=np.int32), np.full(500, 7, dtype=np.int32)
    return out


def test_blocks_find_what_all_pairs_find(monkeypatch):
    codes = variants()
    ids = list(codes)
    random.Random(1).shuffle(ids)
    asked = [i for i in ids if i % 3 != 1]
    table = lambda some: pa.table({"id": pa.array(some, pa.int64()), "root": pa.array([i - i % 2 for i in some], pa.int64()), "codes": pa.array([codes[i].tolist() for i in some], pa.list_(pa.int32()))})
    q, r = chroma.Recordings.of(table(asked)), chroma.Recordings.of(table(ids))
    want = sorted((a, b) for a in asked for b in ids if a - a % 2 != b - b % 2 and aligned(codes, *sorted((a, b))))
    assert len(want) > 20
    for at_once in (1 << 21, 900, 40):
        monkeypatch.setattr(chroma, "AT_ONCE", at_once)
        assert sorted((int(q.ids[i]), int(r.ids[j])) for x, y in chroma.aligned_pairs(q, r) for i, j in zip(x, y)) == want
    assert chroma.block_forest(table([]), table(ids)).num_rows == chroma.block_forest(table(ids), table([])).num_rows == 0


def test_search_links_in_small_blocks(spark):
    codes = variants()
    df = spark.createDataFrame([(i, i, c.tolist(), i % 5 == 0) for i, c in codes.items()], "id long, root long, codes array<int>, query boolean")
    want = roots(codes, [(i, j) for i in codes for j in codes if i < j and (i % 5 == 0 or j % 5 == 0) and aligned(codes, i, j)])
    for block in (500, 1 << 22):
        links = [(r.u, r.v) for r in chroma.search_links(df, block, 3).collect()]
        assert roots(codes, links) == want


def test_helper_columns_do_not_clash_with_the_callers(spark):
    rows = [(1, "m1", 3, [5, 6, 7], "q", "c", 9), (2, "m2", 3, [5, 6, 7], "q", "c", 9), (3, "m3", 0, [], "q", "c", 9)]
    df = spark.createDataFrame(rows, "media_id long, media_digest string, n_frames long, codes array<int>, _query string, _class string, group_id long")
    found = {r.media_id: r for r in chroma.group_recordings(df).collect()}
    assert [found[i].group_id for i in (1, 2, 3)] == [1, 1, 3]
    assert all((r._query, r._class) == ("q", "c") and r.digest for r in found.values())


def test_every_document_is_aligned_with_all(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choices("abcdefgh  ", k=3_000))) for i in range(1, 6)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked, plain = [], chroma.search_links
    monkeypatch.setattr(chroma, "search_links", lambda rooted, *rest: asked.extend(r.id for r in rooted.where("query").collect()) or plain(rooted, *rest))
    chroma.op8_chroma_fingerprints(spark, str(tmp_path)).collect()
    assert sorted(asked) == [1, 2, 3, 4, 5]  # none of these is divisible by 20


def test_each_two_blocks_meet_once(spark, monkeypatch):
    """What is shuffled where all recordings are queries: each once for each block and once more, not 32 times."""
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 31), 1 << 31, 400, dtype=np.int64).astype(np.int32)
    rows = [(i, i, base[i * 5 : i * 5 + 40].tolist(), True) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, root long, codes array<int>, query boolean")
    monkeypatch.setattr(chroma, "block_forest", lambda q, r: pa.table({"u": pa.array([q.num_rows], pa.int64()), "v": pa.array([r.num_rows], pa.int64())}))
    met = [(r.u, r.v) for r in chroma.search_links(df).collect()]
    n = chroma.MIN_WHOLE_BLOCKS
    assert len(met) == n * (n + 1) // 2 and sum(u + v for u, v in met) == (n + 1) * len(rows)


def test_slices_of_a_block_find_what_the_block_does(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 31), 1 << 31, 900, dtype=np.int64).astype(np.int32)
    codes = [base[20 * i : 20 * i + (25 if i % 3 else 50)].tolist() for i in range(40)]
    rows = pa.table({"id": pa.array(range(40), pa.int64()), "root": pa.array(range(40), pa.int64()), "codes": pa.array(codes, pa.list_(pa.int32()))})

    def groups():
        found = chroma.block_forest(rows, rows)
        return roots(range(40), list(zip(found["u"].to_pylist(), found["v"].to_pylist())))

    want = groups()
    assert 1 < len(set(want.values())) < 40
    for size in (1, 30, 100):
        monkeypatch.setattr(chroma, "SLICE_CODES", size)
        assert groups() == want
