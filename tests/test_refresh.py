"""Incremental graphs equal full runs; sets of tables change together or not at all."""

import pytest
from pyspark.sql import functions as F

from orderloom.operators import refresh
from orderloom.plans import dialogue_queries, refresh_queries
from orderloom.plans.base import Tables
from orderloom.sources.tables import TableSet

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_refresh_equals_a_full_run(spark):
    t = Tables(spark, SF)
    _, after, work = refresh_queries.graphs(t)
    full = refresh.build(refresh_queries.sources(t, True), refresh_queries.project, refresh_queries.embed)
    for a, b, cols in ((after.nodes, full.nodes, ["source_id", "hash", "text", "embedding"]), (after.edges, full.edges, [*refresh.EDGE, "props"]), (after.given, full.given, ["origin", "seq", *refresh.EDGE, "props"])):
        assert rows(a, *cols) == rows(b, *cols)
    states = {r.state: r["count"] for r in work.nodes.groupBy("state").count().collect()}
    assert states.keys() == {"added", "removed", "changed", "kept"} and states["kept"] > 50
    assert work.done.count() == states["added"] + states["changed"]
    assert {r.state for r in work.edges.select("state").distinct().collect()} == {"added", "removed", "changed", "kept"}


def test_edges_stay_while_any_node_gives_them(spark):
    given = spark.createDataFrame(
        [("a", 1, "p", "HAS", "x", {"n": "1", "m": "1"}), ("b", 2, "p", "HAS", "x", {"n": "2"}), ("b", 2, "p", "HAS", "y", None), ("c", 3, "q", "HAS", "x", {})],
        "origin string, seq long, source_id string, relation string, target_id string, props map<string,string>",
    )
    nodes = spark.createDataFrame([(k, k) for k in "abc"], "source_id string, hash string")
    project = lambda df: given.join(df.select(F.col("source_id").alias("origin")), "origin", "left_semi")
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
    old = refresh.build(nodes, project, embed)
    assert {(r.source_id, r.target_id): r.props for r in old.edges.collect()} == {("p", "x"): {"n": "2", "m": "1"}, ("p", "y"): {}, ("q", "x"): {}}
    new, work = refresh.refresh(old, nodes.where("source_id <> 'b'"), project, embed)
    assert {(r.source_id, r.target_id): r.state for r in work.edges.collect()} == {("p", "x"): "changed", ("p", "y"): "removed", ("q", "x"): "kept"}
    assert {(r.source_id, r.target_id): r.props for r in new.edges.collect()} == {("p", "x"): {"n": "1", "m": "1"}, ("q", "x"): {}}
    again, idle = refresh.refresh(new, nodes.where("source_id <> 'b'"), project, embed)
    assert idle.done.count() == 0 and rows(again.edges, *refresh.EDGE) == rows(new.edges, *refresh.EDGE)
    gone, _ = refresh.refresh(new, nodes.limit(0), project, embed)
    assert gone.edges.count() == gone.nodes.count() == 0


def test_a_failure_between_two_writes_leaves_the_old_set(spark, tmp_path):
    tables = TableSet(spark, f"{tmp_path}/catalog")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert tables.read() == {} and tables.write({"products": one(1, 2), "variants": one(10, 20)}) == 1
    broken = one(7).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.write({"products": one(3), "variants": broken})
    now = tables.read()
    assert [rows(now[n], "id") for n in ("products", "variants")] == [["(1,)", "(2,)"], ["(10,)", "(20,)"]] and tables.versions() == [1]
    assert tables.write({"variants": one(30)}, since=1) == 2
    with pytest.raises(ValueError, match="version 2"):
        tables.write({"variants": one(40)}, since=1)
    assert rows(tables.read()["products"], "id") == ["(1,)", "(2,)"] and rows(tables.read()["variants"], "id") == ["(30,)"]
    assert rows(tables.read(1)["variants"], "id") == ["(10,)", "(20,)"]


def test_reset_wipes_dependent_tables_at_once_and_old_versions_go(spark, tmp_path):
    tables = TableSet(spark, f"{tmp_path}/graph")
    one = spark.createDataFrame([(1,)], "id long")
    tables.write({"nodes": one, "edges": one, "settings": one})
    held = tables.read()
    assert tables.reset("nodes", "edges") == 2
    now = tables.read()
    assert [now[n].count() for n in ("nodes", "edges", "settings")] == [0, 0, 1] and now["nodes"].columns == ["id"]
    assert held["nodes"].count() == 1  # who reads the old version still can
    tables.write({"nodes": one})
    tables.forget(1)
    assert tables.versions() == [3] and [df.count() for _, df in sorted(tables.read().items())] == [0, 1, 1]
    tables.reset()
    assert all(df.count() == 0 for df in tables.read().values())


def test_a_lost_race_changes_nothing(spark, tmp_path):
    tables = TableSet(spark, f"{tmp_path}/race")
    one = spark.createDataFrame([(1,)], "id long")
    tables.write({"a": one})
    folders = tables.folders()
    tables.write({"a": one.limit(0)})
    with pytest.raises(Exception):
        tables._publish(2, folders)
    assert tables.read()["a"].count() == 0 and not [p for p in (tmp_path / "race/_versions").iterdir() if p.name.startswith("_")]


def test_messages_before_the_first_of_the_user_go(spark):
    log = [(1, 0, "assistant", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "system", "s"), (2, 0, "assistant", "only"), (3, 0, "user", " "), (3, 1, "assistant", "x"), (3, 2, "user", "y"), (4, 0, "user", None), (4, 1, None, "z")]
    found = dialogue_queries.messages_for_model(spark.createDataFrame(log, "conv_id long, turn long, role string, text string"))
    assert sorted((r.conv_id, r.turn) for r in found.collect()) == [(1, 2), (1, 3), (3, 2)]
