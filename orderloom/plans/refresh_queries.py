"""Seed, projection and vectors before and after a change of the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import text as tx
from orderloom.operators import refresh
from orderloom.plans.base import Tables, query

#: What changes between two versions of the sources: parts that come, go and get another price, other FAQ texts, turns that go.
NEW, GONE, DEARER, REWORDED = "p_partkey % 13 = 0", "p_partkey % 11 = 0", "p_partkey % 7 = 0", "item_id % 4 = 0"
CUT = "conv_id % 5 = 0 AND turn = 1"


def sources(t: Tables, after: bool) -> DataFrame:
    """All nodes of one version, with digests: parts, FAQ entries and chunks."""
    price = F.floor("p_retailprice").cast("int")
    price = F.when(F.expr(DEARER), price + 1).otherwise(price) if after else price
    menu = t.part.where(f"NOT ({GONE if after else NEW})").select(
        F.concat(F.lit("menu_"), "p_partkey").alias("source_id"), F.lit("menu").alias("source_type"), F.col("p_partkey").cast("long").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), price.alias("price"),
        F.concat_ws(" | ", "p_name", "p_type", price.cast("string")).alias("text"),
    )
    text = F.when(F.expr(REWORDED), F.concat("text", F.lit(" wifi"))).otherwise(F.col("text")) if after else F.col("text")
    none: dict[str, Column] = {"name": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "price": F.lit(None).cast("int")}
    faq = t.benchmark.select(F.concat(F.lit("faq_"), F.col("item_id").cast("string")).alias("source_id"), F.lit("faq").alias("source_type"), F.col("item_id").cast("long").alias("seq"), text.alias("text")).withColumns(none)
    turns = t.conversations.where(f"NOT ({CUT})") if after else t.conversations
    chunks = turns.select(F.concat_ws("_", F.lit("chunk"), "conv_id", "turn").alias("source_id"), F.lit("chunk").alias("source_type"), F.col("turn").cast("long").alias("seq"), "text").withColumns(none)
    all_ = menu.unionByName(faq).unionByName(chunks)
    return all_.withColumn("hash", refresh.content("source_type", "seq", "name", "category", "price", "text"))


def project(nodes: DataFrame) -> DataFrame:
    """Products' categories and ingredients, from each of their parts; FAQ entries and chunks that speak of wifi or of times."""
    menu = nodes.where("source_type = 'menu'")
    edge = lambda df, source, relation, target, props: df.select(F.col("source_id").alias("origin"), "seq", source.alias("source_id"), F.lit(relation).alias("relation"), target.alias("target_id"), props.alias("props"))
    product = F.concat(F.lit("product::"), "name")
    none = F.lit(None).cast("map<string,string>")
    priced = F.create_map(F.lit("price"), F.col("price").cast("string"))
    found = edge(menu, product, "BELONGS_TO", F.col("category"), priced)
    words = menu.withColumn("word", F.explode(F.array_distinct(F.split("name", " "))))
    found = found.unionByName(edge(words, product, "HAS_INGREDIENT", F.lower("word"), none))
    topics = F.array(F.struct(F.lit("topic::wifi").alias("id"), F.lit("wifi").alias("k")), F.struct(F.lit("topic::time").alias("id"), F.lit("ti").alias("k")))
    told = nodes.where("source_type <> 'menu'").withColumn("topic", F.explode(topics)).where(F.contains(F.lower("text"), F.col("topic.k")))
    return found.unionByName(edge(told, F.col("source_id"), "MENTIONS", F.col("topic.id"), none))


def embed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("embedding", tx.hash_vector(tx.tokens(F.lower("text")), normal=False))


def graphs(t: Tables) -> tuple[refresh.Graph, refresh.Graph, refresh.Work]:
    """The graph of the first version, of the second one by a refresh, and the work done."""
    before = refresh.build(sources(t, False), project, embed)
    return (before, *refresh.refresh(before, sources(t, True), project, embed))


def _version_sql(after: bool) -> str:
    v = "2" if after else "1"
    price = f"floor(p_retailprice)::INT{f' + ({DEARER})::INT' if after else ''}"
    text = f"text || CASE WHEN {REWORDED} THEN ' wifi' ELSE '' END" if after else "text"
    return f"""n{v} AS (
  SELECT 'menu_' || p_partkey AS id, 'menu' AS type, p_partkey AS seq, p_name AS name, p_type AS category, {price} AS price, NULL AS text FROM part WHERE NOT ({GONE if after else NEW})
  UNION ALL SELECT 'faq_' || item_id, 'faq', item_id, NULL, NULL, NULL, {text} FROM benchmark
  UNION ALL SELECT 'chunk_' || conv_id || '_' || turn, 'chunk', turn, NULL, NULL, NULL, text FROM conversations {f'WHERE NOT ({CUT})' if after else ''}),
e{v} AS (
  SELECT 'product::' || name AS s, 'BELONGS_TO' AS relation, category AS d, arg_max(price, seq)::VARCHAR AS price FROM n{v} WHERE type = 'menu' GROUP BY ALL
  UNION ALL SELECT DISTINCT 'product::' || name, 'HAS_INGREDIENT', lower(unnest(string_split(name, ' '))), NULL FROM n{v} WHERE type = 'menu'
  UNION ALL SELECT DISTINCT id, 'MENTIONS', topic, NULL FROM n{v} JOIN (VALUES ('topic::wifi', 'wifi'), ('topic::time', 'ti')) k(topic, word) ON type <> 'menu' AND contains(lower(text), word))"""


@query(f"""WITH {_version_sql(False)}, {_version_sql(True)},
ns AS (SELECT coalesce(a.type, b.type) AS kind, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.price IS DISTINCT FROM b.price OR a.text IS DISTINCT FROM b.text THEN 'changed' ELSE 'kept' END AS state
  FROM n1 a FULL JOIN n2 b ON a.id = b.id)
SELECT 'nodes before' AS step, type AS kind, count(*) AS n FROM n1 GROUP BY type UNION ALL SELECT 'nodes after', type, count(*) FROM n2 GROUP BY type
UNION ALL SELECT 'edges before', relation, count(*) FROM e1 GROUP BY relation UNION ALL SELECT 'edges after', relation, count(*) FROM e2 GROUP BY relation
UNION ALL SELECT 'embedded', kind, count(*) FROM ns WHERE state IN ('added', 'changed') GROUP BY kind UNION ALL SELECT 'node states', state, count(*) FROM ns GROUP BY state""")
def bootstrap_refresh(t: Tables) -> DataFrame:
    """Counts of a full run, of a refresh after a change, and of what the refresh worked on."""
    before, after, work = graphs(t)
    told = lambda df, step, kind: df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "kind", "n")
    found = told(before.nodes, "nodes before", "source_type").unionByName(told(after.nodes, "nodes after", "source_type"))
    found = found.unionByName(told(before.edges, "edges before", "relation")).unionByName(told(after.edges, "edges after", "relation"))
    return found.unionByName(told(work.done, "embedded", "source_type")).unionByName(told(work.nodes, "node states", "state"))


@query(f"""WITH {_version_sql(False)}, {_version_sql(True)}
SELECT coalesce(a.s, b.s) AS source_id, coalesce(a.relation, b.relation) AS relation, coalesce(a.d, b.d) AS target_id, a.price AS price_before, b.price AS price_after,
  CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.price IS DISTINCT FROM b.price THEN 'changed' ELSE 'kept' END AS state
FROM e1 a FULL JOIN e2 b ON a.s = b.s AND a.relation = b.relation AND a.d = b.d""")
def edge_changes(t: Tables) -> DataFrame:
    """Every edge of either version, its property then and now, and whether the refresh added, removed, changed or kept it."""
    price = lambda side: F.try_element_at(side, F.lit("price")).alias(f"price_{side}")
    return graphs(t)[2].edges.select(*refresh.EDGE, price("before"), price("after"), "state")


@query("""WITH v AS (SELECT conv_id || '_' || turn AS source_id, text, turn % 3 AS r FROM conversations)
SELECT source_id, length(text)::INT AS size, CASE r WHEN 0 THEN 'kept' WHEN 1 THEN 'changed' ELSE 'added' END AS state FROM v""")
def stored_vectors(t: Tables) -> DataFrame:
    """Vectors brought up to date: of the stored ones a third stays, a third is of another text, and a third is not there yet; the vectors of nodes that are gone go."""
    nodes = t.conversations.select(F.concat_ws("_", "conv_id", "turn").alias("source_id"), "text", (F.col("turn") % 3).alias("r")).withColumn("hash", refresh.content("text"))
    old = nodes.where("r < 2").withColumn("hash", F.when(F.col("r") == 1, F.lit("other")).otherwise(F.col("hash")))
    gone = old.where("r = 0").withColumn("source_id", F.concat(F.lit("gone_"), "source_id"))
    size = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("double")))
    found = refresh.missing_vectors(nodes, size(old.unionByName(gone)), size)
    state = refresh.changes(old, nodes, ["source_id"])
    return found.join(state, "source_id").select("source_id", F.col("embedding")[0].cast("int").alias("size"), "state")
