"""Contexts of four kinds on small rows, and every fault that they name."""

from pyspark.sql import functions as F

from cohortry.operators import contexts as X

CAPS = ["ball_progression", "threat"]


def players(spark):
    rows = [(1, "Ann", "A", "x", 90.0, 40.0, 0.5, ["Threat", "leader"]), (2, "Bo", "A", "x", 75.0, None, 1.0, []), (3, " ", "B", "y", None, None, 2.0, ["leader"]), (4, "Di", "B", "y", 72.0, 90.0, None, None)]
    return spark.createDataFrame(rows, "id long, name string, team string, position string, ball_progression double, threat double, sure double, signals array<string>")


def contexts(spark):
    return X.player_contexts(players(spark), CAPS, F.col("sure"), F.coalesce("signals", F.array().cast("array<string>")), ["id", "name"])


def test_player_packets_and_faults(spark):
    faults = X.player_faults(F.col("name"), F.col("packets"), F.col("overall_confidence")).alias("faults")
    got = {r["id"]: r for r in contexts(spark).withColumn("faults", faults).collect()}
    ann = got[1]["packets"]
    assert [p["title"] for p in ann] == ["Ball Progression Capability", "Threat Capability"]
    # A strong score takes all signals if none is its own; a weak one only its own.
    assert ann[0]["signals"] == ["Threat", "leader"] and ann[1]["signals"] == ["Threat"] and ann[0]["metrics"][0]["raw_value"] == 90.0
    assert got[1]["faults"] == [] and got[2]["faults"] == [] and len(got[2]["packets"]) == 1
    assert got[3]["faults"] == ["name", "packets", "confidence"] and got[4]["faults"] == ["confidence", "packet:confidence", "packet:confidence"]


def test_packet_without_title_or_score(spark):
    row = spark.range(1).select(F.array(X.packet("threat", F.lit(1.0), F.lit(0.5), F.array().cast("array<string>"))).alias("packets"))
    changed = lambda **by: F.transform("packets", lambda p: F.struct(*[(by.get(c) if c in by else p[c]).alias(c) for c in ("source", "title", "confidence", "metrics", "signals", "caveats")]))
    no_metrics = F.array().cast("array<struct<metric_name:string,raw_value:double,percentile:double,weight:double,explanation:string>>")
    cases = [changed(), changed(title=F.lit(" ")), changed(confidence=F.lit(1.5)), changed(metrics=F.lit(None).cast("array<struct<metric_name:string,raw_value:double,percentile:double,weight:double,explanation:string>>")), changed(metrics=no_metrics), changed(metrics=no_metrics, source=F.lit("other"))]
    got = row.select(*[X.player_faults(F.lit("n"), c, F.lit(1.0)).alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert [list(x) for x in got] == [[], ["packet:title"], ["packet:confidence"], ["packet:metrics"], ["packet:score"], []]


def test_team_context(spark):
    means = spark.createDataFrame([("A", 4, 80.0, 60.0), ("B", 0, 50.0, None)], "team string, squad_size long, ball_progression double, threat double")
    styles = spark.createDataFrame([("A", "Balanced")], "team string, primary_style string")
    hhi = spark.createDataFrame([("A", "threat", 2600.0, True), ("A", "ball_progression", 900.0, False)], "team string, capability string, hhi double, over_centralised boolean")
    narrow = spark.createDataFrame([("A", "u", "v", 3.0), ("A", "w", "v", 9.0)], "team string, upstream string, downstream string, severity double")
    fragile = spark.createDataFrame([("A", i, f"p{i}", 1.0, float(i % 4)) for i in range(6)], "team string, id long, name string, loss double, deficit double")
    got = {r["team"]: r for r in X.team_contexts(means, "team", CAPS, styles, hhi, narrow, fragile, "id", "name").withColumn("faults", X.team_faults(F.col("team"))).collect()}
    a, b = got["A"], got["B"]
    assert [x["capability"] for x in a["risks"]] == ["threat"] and [x["upstream"] for x in a["bottlenecks"]] == ["w", "u"] and [x["id"] for x in a["fragilities"]] == [3, 2, 1]
    assert [p["title"] for p in a["packets"]] == ["Ball Progression Capability (Squad Avg)", "Threat Capability (Squad Avg)"] and a["faults"] == []
    assert b["risks"] == b["bottlenecks"] == b["fragilities"] == [] and len(b["packets"]) == 1 and b["faults"] == ["squad_size", "style"]


def test_comparison_and_recruitment(spark):
    p = players(spark)
    pairs = spark.createDataFrame([(1, 4), (2, None), (3, 1)], "id long, other long")
    c = X.comparison_contexts(pairs, "id", "other", contexts(spark), p, CAPS).withColumn("faults", X.comparison_faults("name"))
    got = {r["id"]: r for r in c.collect()}
    assert got[1]["shared_strengths"] == ["ball_progression"] and got[1]["key_differences"] == ["ball_progression", "threat"] and [x["name"] for x in got[1]["players"]] == ["Ann", "Di"]
    assert got[1]["faults"] == ["confidence", "packet:confidence", "packet:confidence"] and got[2]["faults"] == ["players"] and got[3]["faults"] == ["name", "packets", "confidence"]
    positions = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "position string")
    candidates = p.withColumn("fit_score", F.col("ball_progression"))
    r = X.recruitment_contexts(positions, "position", candidates, "name", {"ball_progression": 1.0, "threat": 1.0}, "Balanced", 5).withColumn("faults", X.recruitment_faults(F.col("position")))
    got = {r["position"]: r for r in r.collect()}
    assert [(x["player_name"], x["rank"], x["strengths"], x["trade_offs"]) for x in got["x"]["candidates"]] == [("Ann", 1, ["ball_progression"], ["threat"]), ("Bo", 2, [], [])]
    assert got["x"]["faults"] == [] and got["y"]["faults"] == ["fit_score:1", ] and got["z"]["faults"] == ["candidates"] and got[None]["faults"] == ["position", "candidates"]
