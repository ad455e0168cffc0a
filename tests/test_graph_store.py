"""The stored graph: bucketed adjacency, names, reports counted during the write, one set of scores a query."""

import os

from cohortry.operators import graph as G
from cohortry.plans import base
from cohortry.plans import queries as Q
from cohortry.sources.tables import new_folder, save_reported

SF = "/root/testdata/sf0.001"


def graph(spark):
    edges = [("a", "1", "b", "1", "X"), ("a", "1", "b", "2", "X"), ("b", "1", "c", "1", "X"), ("c", "1", "a", "1", "X"), ("b", "1", "c", "1", "Y"), ("b", "2", "b", "2", "X")]
    nodes = [("a", "1", "Ann"), ("b", "1", "Bo"), ("b", "2", None), ("c", "1", "Cy"), ("c", "1", "Cy")]
    return spark.createDataFrame(edges, "source_type string, source_id string, target_type string, target_id string, edge_type string"), spark.createDataFrame(nodes, "node_type string, node_id string, name string")


def test_walk_and_names(spark):
    edges, nodes = graph(spark)
    links = G.adjacency(edges)
    found = G.walk(links, spark.createDataFrame([("a:1",), ("z:9",)], "source string"), 3)
    got = {(tuple(r["path"]), r["hops"], tuple(r["names"])) for r in G.with_names(found, nodes).collect()}
    assert got == {(("a:1", "b:1"), 1, ("Ann", "Bo")), (("a:1", "b:2"), 1, ("Ann", "b:2")), (("a:1", "b:1", "c:1"), 2, ("Ann", "Bo", "Cy"))}
    assert G.entity(nodes, "b", "1").first()["name"] == "Bo" and G.nodes_by_type(nodes, "b").count() == 2 and G.entity(nodes, "b", "7").isEmpty()


def test_links_are_not_shuffled(spark):
    edges, _ = graph(spark)
    links = G.adjacency(edges)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = G.walk(links, spark.createDataFrame([("a:1",)], "source string"), 2).where("hops = 2")
    text = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Under each join, the links come sorted from their scan, the paths from an exchange.
    lines = text.split("\n")
    scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x]
    assert scans and all("Bucketed: true" in lines[i] and "Sort [source" in lines[i - 3] and not any("Exchange" in x for x in lines[i - 3 : i]) for i in scans)


def test_report_counts_what_was_written(spark):
    df = spark.createDataFrame([("x", 1), ("x", -1), ("y", None), (None, 3)], "kind string, v int")
    from pyspark.sql import functions as F

    path = new_folder(spark)
    assert save_reported(df, path, "kind", ["x", "z"], {"negative": F.col("v") < 0}) == {"x": 2, "z": 0, "other": 2, "negative": 1}
    assert spark.read.parquet(path).count() == 4
    assert save_reported(df.where("false"), path, "kind", ["x"]) == {"x": 0}


def test_scores_are_computed_once_a_query(spark, monkeypatch):
    calls = []
    make = base._entity_scores
    monkeypatch.setattr(base, "_entity_scores", lambda s, d: calls.append(d) or make(s, d))
    for name in ("graph_edges", "tactical_fit", "snapshot", "evidence_packets"):
        calls.clear()
        Q.QUERIES[name](spark, SF)
        assert len(calls) == 1, name
    calls.clear()
    Q.QUERIES["two_hop_paths"](spark, SF)
    assert not calls and os.path.isdir(SF)
