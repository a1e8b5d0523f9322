"""Seed, projection and vectors as one chain that works again only on what a change touches.

Nodes carry a digest of their content. A refresh compares digests, projects and embeds what is new or changed, drops
what is gone, and gives the same graph as a run over everything. Edges are kept as what each node gives: an edge stays
as long as any node gives it, and its properties are those last given.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = ["source_id", "relation", "target_id"]
ADDED, REMOVED, CHANGED, KEPT = "added", "removed", "changed", "kept"


def content(*columns: str) -> Column:
    """A digest of the columns' values, nulls and names included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str = "hash", of_old: dict[str, str] | None = None, of_new: dict[str, str] | None = None) -> DataFrame:
    """keys and state: added, removed, changed or kept, by the value; keys are unique on either side and not null. of_old, of_new: columns to take along, under new names."""
    side = lambda df, name, mark, more: df.select(*keys, F.col(value).alias(name), F.lit(True).alias(mark), *[F.col(c).alias(n) for n, c in (more or {}).items()])
    both = side(old, "_old", "_was", of_old).join(side(new, "_new", "_is", of_new), keys, "full")
    state = F.when(F.col("_was").isNull(), ADDED).when(F.col("_is").isNull(), REMOVED).when(F.col("_old").eqNullSafe(F.col("_new")), KEPT).otherwise(CHANGED)
    return both.select(*keys, state.alias("state"), *(of_old or {}), *(of_new or {}))


def merged_edges(given: DataFrame) -> DataFrame:
    """One row per edge with props, a map: of each property the value given last (seq, then value). given: origin, seq, EDGE and props, a map, null for none."""
    edges = given.select(*EDGE).distinct()
    entries = given.select(*EDGE, "seq", F.explode("props").alias("name", "value"))
    last = entries.groupBy(*EDGE, "name").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    props = last.groupBy(*EDGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
    none = F.create_map().cast("map<string,string>")
    return edges.join(props, EDGE, "left").withColumn("props", F.coalesce("props", none))


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """EDGE, state, before and after: the merged edges of two graphs with their properties, a map, in each."""
    entries = lambda df: df.select(*EDGE, "props", F.array_sort(F.map_entries("props")).alias("entries"))
    both = changes(entries(old), entries(new), EDGE, "entries", {"before": "props"}, {"after": "props"})
    return both.select(*EDGE, "state", "before", "after")


class Graph(NamedTuple):
    """nodes: source_id, hash, what else they have, and embedding; given: what they give; edges: merged."""

    nodes: DataFrame
    given: DataFrame
    edges: DataFrame


class Work(NamedTuple):
    """What a refresh did: nodes and edges by state, and the nodes that were projected and embedded."""

    nodes: DataFrame
    edges: DataFrame
    done: DataFrame


Step = Callable[[DataFrame], DataFrame]


def build(nodes: DataFrame, project: Step, embed: Step) -> Graph:
    """A full run. project gives edges (origin, seq, EDGE, props) of nodes, each from its own row; embed adds embedding."""
    given = project(nodes)
    return Graph(embed(nodes), given, merged_edges(given))


def refresh(old: Graph, nodes: DataFrame, project: Step, embed: Step) -> tuple[Graph, Work]:
    """old brought up to date with nodes (all there are now, with hash), and what was done for it.

    Nodes whose digest is as before are neither projected nor embedded, and edges that no touched node gives or gave
    are taken over as they are.
    """
    state = changes(old.nodes, nodes, ["source_id"])
    touched = state.where(F.col("state") != KEPT).select("source_id")
    work = nodes.join(state.where(F.col("state").isin(ADDED, CHANGED)).select("source_id"), "source_id", "left_semi")
    origin = touched.withColumnRenamed("source_id", "origin")
    fresh, stale = project(work), old.given.join(origin, "origin", "left_semi")
    given = old.given.join(origin, "origin", "left_anti").unionByName(fresh)
    keys = fresh.select(*EDGE).unionByName(stale.select(*EDGE)).distinct()
    edges = old.edges.join(keys, EDGE, "left_anti").unionByName(merged_edges(given.join(keys, EDGE, "left_semi")))
    found = Graph(old.nodes.join(touched, "source_id", "left_anti").unionByName(embed(work)), given, edges)
    return found, Work(state, edge_changes(old.edges, edges), work)


def missing_vectors(nodes: DataFrame, stored: DataFrame, embed: Step) -> DataFrame:
    """stored vectors (source_id, hash, embedding) with those of new and changed nodes (source_id, hash, text), and without those of nodes that are gone."""
    state = changes(stored, nodes, ["source_id"])
    todo = nodes.join(state.where(F.col("state").isin(ADDED, CHANGED)).select("source_id"), "source_id", "left_semi")
    kept = stored.join(state.where(F.col("state") == KEPT).select("source_id"), "source_id", "left_semi")
    return kept.select("source_id", "hash", "embedding").unionByName(embed(todo).select("source_id", "hash", "embedding"))
