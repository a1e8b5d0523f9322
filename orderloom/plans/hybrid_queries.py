"""Hybrid and graph retrieval over menu, FAQ and entity nodes: the flagship plan, and its modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx
from orderloom.operators import catalog, retrieval
from orderloom.plans.base import RETRIEVAL_SQL, Tables, asked, nodes, query, rounded
from orderloom.plans.catalog_queries import LEXICAL_SQL

MODES = ["keyword", "vector", "hybrid", "hybrid_graph", "other"]


def with_vector(df: DataFrame) -> DataFrame:
    """The hashed bag of a text's words stands in for a model's vector."""
    return df.withColumn("embedding", tx.hash_vector(tx.tokens(F.lower("text")), normal=False))


def graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries, nodes (entities included) and edges."""
    found = nodes(t)
    k = t.part.select(F.explode(F.split("p_name", " ")).alias("k")).select(F.substring("k", 1, 3).alias("k")).distinct()
    entities = k.select(F.concat(F.lit("topic::"), "k").alias("entity_id"), "k", F.array("k").alias("keywords"))
    edges = catalog.mention_edges(found.where("source_type = 'faq'").select("source_id", "text"), entities)
    known = entities.select(F.col("entity_id").alias("source_id"), F.lit("entity").alias("source_type"), retrieval.entity_passage(F.col("k"), F.lit("topic")).alias("text"))
    return asked(t), found.unionByName(known, allowMissingColumns=True), edges


BAG = r"list_filter(string_split_regex(trim(lower(text)), '\s+'), lambda w: w <> '')"
SLOT = "(('0x' || right(md5(w), 3))::INT & 1023)"

#: kranked: keyword hits by place; vranked: vector hits by place; fused by place, for pools of 5 and of 20.
HYBRID_SQL = rf"""{RETRIEVAL_SQL},
kranked AS (SELECT query_id, intent, source_id, source_type, text, score, place FROM ranked),
nv AS (SELECT source_id, source_type, slot, count(*) AS c FROM (SELECT source_id, source_type, {SLOT} AS slot FROM (SELECT source_id, source_type, unnest({BAG}) AS w FROM nodes)) GROUP BY ALL),
qv AS (SELECT query_id, intent, slot, count(*) AS c FROM (SELECT query_id, intent, {SLOT} AS slot FROM (SELECT query_id, intent, unnest({BAG}) AS w FROM asked)) GROUP BY ALL),
nn AS (SELECT source_id, sqrt(sum(c * c)::DOUBLE) AS n FROM nv GROUP BY source_id),
qn AS (SELECT query_id, sqrt(sum(c * c)::DOUBLE) AS n FROM qv GROUP BY query_id),
cosines AS (SELECT query_id, intent, source_id, source_type, sum(qv.c * nv.c)::DOUBLE / (any_value(qn.n) * any_value(nn.n)) AS score FROM qv JOIN nv USING (slot) JOIN qn USING (query_id) JOIN nn USING (source_id)
  WHERE (intent = 'order' AND source_type = 'menu') OR (intent = 'consultant' AND source_type IN ('menu', 'faq')) OR (intent = 'faq' AND source_type = 'faq') GROUP BY ALL),
typed AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY round(score, 9) DESC, source_id) AS r FROM cosines WHERE score >= 0.05),
vplaced AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source_id) AS place FROM typed t WHERE r <= 20),
vhits AS (SELECT query_id, intent, source_id, v.source_type, nodes.text, score, place FROM vplaced v JOIN nodes USING (source_id)),
sizes AS (SELECT unnest([5, 20]) AS k),
fused AS (SELECT k, query_id, intent, source_id, source_type, min(text) AS text, sum(score) AS score FROM (
    SELECT k, query_id, intent, source_id, source_type, text, score * CASE WHEN intent = 'faq' THEN 0.45 ELSE 0.65 END::DOUBLE AS score FROM kranked, sizes WHERE place <= k
    UNION ALL SELECT k, query_id, intent, source_id, source_type, text, score * CASE WHEN intent = 'faq' THEN 0.55 ELSE 0.35 END::DOUBLE FROM vhits, sizes WHERE place <= k) GROUP BY ALL),
fplaced AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 9) DESC, source_id) AS place FROM fused),
hybrid AS (SELECT k, query_id, intent, source_id, f.source_type, f.text,
    score + CASE WHEN intent = 'faq' AND (topic = 'wifi' OR contains(lower(f.text), 'wifi')) THEN 0.35 ELSE 0 END::DOUBLE AS score FROM fplaced f JOIN nodes USING (source_id) WHERE place <= k)"""

GRAPH_SQL = f"""{HYBRID_SQL},
pool AS (SELECT * FROM hybrid WHERE k = 20),
kin AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY source_id) AS i FROM nodes WHERE source_type = 'menu'),
sib AS (SELECT query_id, intent, s.source_id, s.source_type, s.text, r.score * 0.75::DOUBLE * 0.65::DOUBLE AS score FROM pool r JOIN kin own ON own.source_id = r.source_id
  JOIN kin s ON s.category = own.category AND s.source_id <> own.source_id AND s.i <= CASE WHEN own.i <= 5 THEN 6 ELSE 5 END WHERE r.source_type = 'menu'),
topics AS (SELECT DISTINCT substr(unnest(string_split(p_name, ' ')), 1, 3) AS k FROM part),
mentions AS (SELECT DISTINCT source_id, topics.k AS topic_key FROM nodes JOIN topics ON contains(lower(text), topics.k) WHERE source_type = 'faq'),
told AS (SELECT query_id, intent, 'topic::' || topic_key AS source_id, 'entity' AS source_type, 'Entity: ' || topic_key || ' | Type: topic' AS text, score * 0.75::DOUBLE * 0.85::DOUBLE AS score
  FROM (SELECT p.*, topic_key, row_number() OVER (PARTITION BY query_id, source_id ORDER BY 'topic::' || topic_key) AS r FROM pool p JOIN mentions USING (source_id) WHERE source_type = 'faq') WHERE r <= 10),
wide AS (SELECT query_id, intent, source_id, source_type, text, score, false AS expanded FROM pool UNION ALL SELECT *, true FROM sib UNION ALL SELECT *, true FROM told),
each AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, expanded) AS r FROM wide) WHERE r = 1),
words_of AS (SELECT e.*, {LEXICAL_SQL.format("q.text")} AS qt, {LEXICAL_SQL.format("e.text")} AS bt FROM each e JOIN asked q USING (query_id)),
light AS (SELECT query_id, source_id, source_type, (score + CASE WHEN len(qt) = 0 OR len(bt) = 0 THEN 0 ELSE len(list_intersect(qt, bt))::DOUBLE / len(qt) END * 0.15::DOUBLE)
  * CASE WHEN expanded THEN 0.85 ELSE 1 END::DOUBLE * CASE WHEN intent = 'order' AND source_type = 'menu' THEN 1.1 WHEN intent = 'faq' AND source_type = 'faq' THEN 1.1
    WHEN intent = 'consultant' AND source_type IN ('menu', 'document') THEN 1.05 ELSE 1 END::DOUBLE AS score FROM words_of),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source_id) AS place FROM light)"""


@query(f"WITH {GRAPH_SQL} SELECT query_id, source_id, round(score, 6) AS score FROM final WHERE place <= 5")
def graph_retrieval(t: Tables) -> DataFrame:
    """The flagship: keyword and vector search fused, a pool of twenty, its neighbours by type, rerank, the best five."""
    return rounded(retrieval.retrieve_with_graph(*graph(t), embed=with_vector).select("query_id", "source_id", "score"), "score")


@query(f"""WITH {GRAPH_SQL} SELECT mode, query_id, source_id, source_type, round(score, 6) AS score FROM (
  SELECT unnest(['keyword', 'other']) AS mode, query_id, source_id, source_type, score FROM kranked WHERE place <= 5 UNION ALL SELECT 'vector', query_id, source_id, source_type, score FROM vhits WHERE place <= 5
  UNION ALL SELECT 'hybrid', query_id, source_id, source_type, score FROM hybrid WHERE k = 5 UNION ALL SELECT 'hybrid_graph', query_id, source_id, source_type, score FROM final WHERE place <= 5)""")
def retrieve_auto(t: Tables) -> DataFrame:
    """Every mode, and one that is unknown, which is keyword search."""
    return rounded(retrieval.retrieve_modes(MODES, *graph(t), embed=with_vector), "score")


assert lx.TOP_K == 5 and lx.POOL == 20
