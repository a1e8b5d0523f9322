"""Prefix tries of conversations, built in hash parts of their first turns.

Conversations are sequences of turns. Every distinct sequence of first turns is a node; a conversation is a member of
the nodes that it starts with, the textless root included. Turns travel as digests of role and text, with their word
counts; texts stay in the scan.

Equal sequences are one weighted row, so a group of copies of any size is one row in the tries. The ids of those that
end at a node are hashed in order of their numbers: ranges of (sequence, id) are joined to strings in parallel, and what
runs over one node is only a running digest over those strings.

Sequences are dealt by the hash of their first turn into groups of about GROUP turns, and each group builds its tries
inside applyInPandas: a dictionary of pointers a node, and totals in postorder without recursion. A first turn with more
than GROUP turns below it is not given to one task: it is split by the next turn, and those parts again, until every part
fits or is a single sequence. Nodes above the parts get their totals as sums of what the parts send up.

A conversation is one row, and its turns are sorted together. Turns sort by number (null first), then role, then digest
of role and text; null role or text is empty. Repeated turns stay. Turns without conv_id belong to no conversation and are
left out. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import WORD, materialize, table, text_of

#: Turns of a group of tries that one task builds at a time.
GROUP = 2000
#: Ids that are joined to one string.
IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = ""
NODE, UPPER, SUM = 0, 1, 2
PARTS = (
    "kind int, prefix string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: array of (turn, role, digest, words), in order."""
    role, text = text_of("role"), text_of("text")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def paths(seqs: DataFrame, turns: str | Column = "turns") -> DataFrame:
    """conv_id, path (digests), words (counts) and seq, the digest of the path."""
    part = lambda field: F.transform(turns, lambda t: t[field])
    return seqs.select("conv_id", part("digest").alias("path"), part("words").alias("words")).withColumn("seq", F.md5(F.array_join("path", "")))


def joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of at most IDS ids of one sequence, from rows sorted by sequence and id."""
    for rows in batches:
        same = (rows["seq"] != rows["seq"].shift()).cumsum()
        part = rows.groupby(same).cumcount() // IDS
        found = rows.assign(text=rows["conv_id"].astype(str)).groupby([same.rename("run"), part.rename("part")], sort=False)
        yield found.agg(seq=("seq", "first"), at=("conv_id", "first"), ids=("text", ",".join)).reset_index(drop=True)


def hashed_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each sequence's ids, from their strings in order; one running digest is held."""
    now, running = None, None
    for rows in batches:
        out = []
        for seq, ids in zip(rows["seq"], rows["ids"]):
            if seq != now:
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, running = seq, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield pd.DataFrame(out, columns=["seq", "ends"])
    if now is not None:
        yield pd.DataFrame([(now, running.hexdigest())], columns=["seq", "ends"])


def distinct_sequences(found: DataFrame) -> DataFrame:
    """first (the least conv_id), n, ends, path and words of each distinct sequence; found (paths) is read more than once."""
    counts = materialize(found.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")), "sequence-counts")
    shared = found.select("seq", "conv_id").join(counts.where("n > 1").select("seq"), "seq", "left_semi")
    strings = shared.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInPandas(joined_ids, "seq string, at long, ids string")
    ends = strings.repartition("seq").sortWithinPartitions("seq", "at").mapInPandas(hashed_ids, "seq string, ends string")
    whole = found.select(F.col("conv_id").alias("first"), "path", "words")
    ended = F.coalesce("ends", F.sha2(F.col("first").cast("string"), 256)).alias("ends")
    return counts.join(ends, "seq", "left").select("first", "n", ended).join(whole, "first")


def below(before: str, turn: str) -> str:
    """The digest of a prefix that goes on with turn."""
    return hashlib.md5((before + turn).encode()).hexdigest()


def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every prefix of every sequence, with the turns that the sequence has from its end on."""
    for rows in batches:
        for first, n, path in zip(rows["first"], rows["n"], rows["path"]):
            digests, p = [], ROOT
            for turn in path:
                digests.append(p := below(p, turn))
            depth = range(1, len(path) + 1)
            yield pd.DataFrame({"first": first, "n": n, "depth": depth, "prefix": digests, "turns": range(len(path), 0, -1)})


def parted(seqs: DataFrame, group: int = GROUP) -> DataFrame:
    """seqs (read more than once), above: the prefixes that are too large for a task, with their counts, and top: the digest of the first prefix that fits.

    Sizes of prefixes fall with depth, so those in above are a sequence's first ones.
    """
    key = F.get("path", F.lit(0)).alias("key")
    too_large = lambda turns, n: (F.sum(turns) > group) & (F.count("*") > n)
    large = seqs.groupBy(key).agg(too_large(F.size("path"), 1).alias("large")).where("large")
    marked = materialize(seqs.select("*", key).join(large, "key", "left").drop("key"), "sequences")
    hot = marked.where("large").drop("large")
    every = materialize(hot.select("first", "n", "path").mapInPandas(prefixes, "first long, n long, depth int, prefix string, turns long"), "prefixes")
    upper = every.groupBy("prefix").agg(too_large(F.col("turns"), 1).alias("large"), F.sum("n").alias("n_convs"), F.min("first").alias("least")).where("large")
    place = F.struct("depth", "prefix", "n_convs", "least")
    above = every.select("first", "depth", "prefix").join(upper, "prefix").groupBy("first").agg(F.sort_array(F.collect_list(place)).alias("above"))
    cold = marked.where("large IS NULL").drop("large").withColumn("above", F.array().cast(above.schema["above"].dataType))
    both = cold.unionByName(hot.join(above, "first"))
    last = F.coalesce(F.get("above", F.size("above") - 1)["prefix"], F.lit(ROOT))
    turn = F.get("path", F.size("above"))
    return both.withColumn("top", F.when(turn.isNotNull(), F.md5(F.concat(last, turn))).otherwise(last))


def tries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of some tops, rows of the nodes above that the sequences stand for, and sums sent up to those."""
    out: list[tuple] = []
    sums: dict[str, list] = defaultdict(lambda: [0, 0, 0, None])  # children, leaves, saved tokens, ends
    for _, part in rows.groupby("top", sort=False):
        kids, parent, depth, words, n, first, ends = [{}], [-1], [0], [0], [0], [None], [None]
        above = part["above"].iloc[0]
        over = [a["prefix"] for a in above]
        for row in part.itertuples(index=False):
            at = 0
            for i in range(len(above), len(row.path)):
                if (to := kids[at].get(row.path[i])) is None:
                    to = kids[at][row.path[i]] = len(kids)
                    for held, value in zip((kids, parent, depth, words, n, first, ends), ({}, at, i + 1, int(row.words[i]), 0, row.first, None)):
                        held.append(value)
                at = to
            n[at] += row.n
            first[at] = row.first if first[at] is None else min(first[at], row.first)
            ends[at] = row.ends
            saved = 0
            for i in range(len(above) - 1, -1, -1):  # nodes above are told by the sequence of their least conversation
                if above[i]["least"] == row.first:
                    saved += (above[i]["n_convs"] - 1) * int(row.words[i])
                    out.append((UPPER, over[i], row.first, i + 1, above[i - 1]["least"] if i else None, above[i]["n_convs"], 0, 0, 0, None))
                    sums[over[i - 1] if i else ROOT][0] += 1
                sums[over[i]][2] += saved
            sums[ROOT][2] += saved
        leaves, saved = [0] * len(kids), [0] * len(kids)
        for at in range(len(kids) - 1, 0, -1):  # children come after their parents, so this is a postorder
            leaves[at] = leaves[at] or 1
            saved[at] += (n[at] - 1) * words[at]
            up = parent[at]
            leaves[up] += leaves[at]
            saved[up] += saved[at]
            n[up] += n[at]
            if up:
                first[up] = min(first[up], first[at])
        outer = above[-1]["least"] if len(above) else None
        for at in range(1, len(kids)):
            out.append((NODE, None, first[at], depth[at], first[parent[at]] if parent[at] else outer, n[at], len(kids[at]), leaves[at], saved[at], ends[at]))
        for p in [ROOT, *over]:
            sums[p][1] += leaves[0]
            sums[p][2] += saved[0]
        last = sums[over[-1] if over else ROOT]
        last[0] += len(kids[0])
        last[3] = ends[0] or last[3]
    out += [(SUM, p, None, None, None, None, c, v, s, e) for p, (c, v, s, e) in sums.items()]
    return pd.DataFrame(out, columns=["kind", "prefix", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]).astype(
        {c: "Int64" for c in ("conv_id", "depth", "parent_conv_id", "n_convs")}
    )


def trie(seqs: DataFrame, turns: str = "turns", group: int = GROUP) -> DataFrame:
    """Nodes of the trie over sequences (conv_id, one row each, and turns as sequences() gives them).

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    found = materialize(paths(seqs, turns), "paths")
    all_ = found.agg(F.count("*"), F.min("conv_id")).first()
    cut = materialize(parted(materialize(distinct_sequences(found), "distinct-sequences"), group), "parted")
    size = cut.agg(F.sum(F.size("path") - F.size("above"))).first()[0] or 0
    parts = F.pmod(F.xxhash64("top"), F.lit(max(1, -(-size // group)))).alias("part")
    built = materialize(cut.select("*", parts).groupBy("part").applyInPandas(lambda rows: tries(rows), PARTS), "tries")
    total = lambda c: F.sum(c).cast("long").alias(c)
    sums = built.where(F.col("kind") == SUM).groupBy("prefix").agg(*map(total, ("n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    upper = built.where(F.col("kind") == UPPER).select("prefix", "conv_id", "depth", "parent_conv_id", "n_convs").join(sums, "prefix")
    fixed = {"conv_id": all_[1], "depth": 0, "parent_conv_id": None, "n_convs": all_[0]}
    root = sums.where(F.col("prefix") == ROOT).select("prefix", *[F.lit(v).cast("long").alias(c) for c, v in fixed.items()], "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends")
    nodes = built.where(F.col("kind") == NODE).select(names).unionByName(upper.select(names))
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(all_[1]).cast("long"))).unionByName(root.select(names))
    return nodes.select(*names[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def rebuilt(seqs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Each conversation with its first turns, up to most of them by its id's checksum, taken from the one at the multiple of every before it."""
    base = lambda c: c - c % every
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    none = F.filter("turns", lambda t: F.lit(False))
    both = seqs.withColumn("base", base(F.col("conv_id"))).join(heads, "base", "left")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return both.select("conv_id", turns.alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = materialize(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "conversation-turns")
    return trie(rebuilt(seqs))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, in DuckDB SQL; needs a join with the one row of crc_table."""
    data = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {data}, lambda c, b: xor(c >> 8, crc_t[((xor(c, b) & 255) + 1)::INT])), 4294967295)"


CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crc_t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

OP13_SQL = f"""WITH {CRC_TABLE},
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'d': md5(length(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))}}
    ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS ts FROM turns GROUP BY 1),
hs AS (SELECT conv_id, ts, ({crc32_sql("conv_id::VARCHAR")} % 4)::INT AS h FROM own, crc_table),
rebuilt AS (SELECT a.conv_id, coalesce(b.ts[1:a.h], []) || a.ts[a.h + 1:] AS ts FROM hs a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (SELECT conv_id, d, list_transform(ts[1:d], lambda t: t.d) AS p, coalesce(ts[d].w, 0) AS w, len(ts) = d AS ends
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, min(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM prefixes GROUP BY p, d),
kids AS (SELECT p[:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n - 1) * w AS saved, (n_children IS NULL)::INT AS leaf FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT p[:k] AS p, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own_sums) GROUP BY 1)
SELECT o.conv_id, o.d::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children, s.n_leaves, s.saved_tokens, sha256(o.e) AS ends_sha256
FROM own_sums o JOIN sums s ON s.p = o.p LEFT JOIN nodes u ON o.d > 0 AND u.p = o.p[:o.d - 1]
"""
