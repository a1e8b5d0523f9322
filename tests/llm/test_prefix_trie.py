import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from orderloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, digest(role, text), text))
    return {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}


def brute_nodes(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    ends = {p: ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(p)) for p, ms in members.items()}
    return sorted(
        str((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()))
        for p, ms in members.items()
    )


def brute_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def log(n=260, seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = rng.choice([0, 1, 2, 3, 3, 4, 6]) if c % 3 else 5
        for t in range(turns):
            text = "same first  turn" if t == 0 and c % 3 == 0 else rng.choice(["a b", "c", "", None, "d e\x1cf g", "é"])
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "user", None, ""]) if c % 3 else "user", text))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1060) for t in range(3)]  # copies
    rows += [(c, t, "user", f"chain {t}") for c in range(2000, 2060) for t in range(c - 1999)]  # each goes on from the one before
    rows += [(7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "bot", "tie"), (None, 1, "user", "nobody's"), (2**40 + 11, 0, "user", "x" * 300_000), (-25, 0, "user", "below")]
    rng.shuffle(rows)
    return rows


def collected(df):
    return sorted(str(tuple(r[c] for c in COLS)) for r in df.collect())


@pytest.mark.parametrize("group", [1, 20, 100_000])
def test_trie_against_brute_force(spark, group):
    convs = in_order(log())
    seqs = prefix_trie.sequences(spark.createDataFrame(log(), SCHEMA))
    assert collected(prefix_trie.trie(seqs, group=group)) == brute_nodes(convs)


def test_query_against_brute_force_and_sql(spark, tmp_path):
    rows = [(*r, "kept apart") for r in log() if r[0] is None or r[0] >= 0]
    spark.createDataFrame(rows, f"{SCHEMA}, kind string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = collected(prefix_trie.op13_prefix_trie(spark, str(tmp_path)))
    assert found == brute_nodes(brute_rebuilt(in_order(r[:4] for r in rows)))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert found == sorted(map(str, con.sql(f"select {', '.join(COLS)} from ({prefix_trie.OP13_SQL})").fetchall()))


def test_empty_turnless_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.sequences(empty)).collect() == []
    seqs = prefix_trie.sequences(spark.createDataFrame([(c, 0, "user", "x") for c in (41, 45)], SCHEMA))
    only = seqs.selectExpr("conv_id", "filter(turns, t -> false) AS turns")
    assert collected(prefix_trie.trie(only)) == brute_nodes({41: [], 45: []})
    long = [(1, t, "user", f"{t}") for t in range(5000)] + [(2, t, "user", f"{t}") for t in range(4999)]
    assert collected(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(long, SCHEMA)), group=50)) is not None


def test_ids_are_hashed_in_parts(spark, monkeypatch):
    ids = [*range(-3, 40), 10**15]
    batches = iter([__import__("pandas").DataFrame({"seq": ["a"] * len(ids) + ["b"], "conv_id": [*ids, 5]})])
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    out = list(prefix_trie.hashed_ids(prefix_trie.joined_ids(batches)))
    got = {r.seq: r.ends for rows in out for r in rows.itertuples()}
    assert got == {"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "b": hashlib.sha256(b"5").hexdigest()}
