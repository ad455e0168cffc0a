"""Single operators on small tables: golden values, nulls, ties, invariants."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalar as S
from cohortry.operators import cohort as K
from cohortry.operators import decisions as D
from cohortry.operators import graph as G
from cohortry.operators import normalize as N
from cohortry.operators import quality as Q
from cohortry.operators import scoring, teams, text
from cohortry.sources import tables as src

CAPS = ["progression", "creation", "security", "resistance", "defence", "threat"]
SCHEMA = "id long, name string, position string, team string, minutes long, " + ", ".join(f"{c} double" for c in CAPS)


@pytest.fixture(scope="module")
def players(spark):
    rows = [(1, "Ada", "Winger", "Elm", 1450, 62.0, 71.0, 58.0, 74.0, 33.0, 66.0), (2, "Bo", "Winger", "Oak", 1720, 64.0, 77.0, 52.0, 71.0, 30.0, 73.0), (3, "Cy", "Fullback", "Ash", 990, 48.0, 36.0, 69.0, 73.0, 88.0, 21.0)]
    return spark.createDataFrame(rows, SCHEMA)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_golden_ranking(players):
    got = D.rank_candidates(players, "id", {"creation": 0.6, "threat": 0.4}).collect()
    assert [(r["name"], r["fit_score"]) for r in got][:2] == [("Bo", 75.4), ("Ada", 69.0)]
    assert D.rank_candidates(players, "id", {}, where=F.col("minutes") >= 1500, excluded=players.where("id = 3")).first()["fit_score"] == 50.0


def test_replacement_and_comparison(players):
    r = D.replacements(players, "id", "position", "team", CAPS, asked=F.col("id") == 1).collect()
    assert [x["candidate"] for x in r] == [2]
    tall = teams.long_scores(players.where("id IN (1, 3)"), ["id"], CAPS).withColumn("g", F.lit(1))
    c = {x["capability"]: x for x in D.comparison(tall, ["g"], "id").collect()}
    assert c["defence"]["key_difference"] and c["defence"]["best"] == 3 and c["defence"]["worst"] == 1 and c["defence"]["high"] == 88.0
    assert c["resistance"]["shared_strength"] and not c["resistance"]["key_difference"]


def test_scalars(spark):
    r = one(
        spark, S.pct(F.lit(1), F.lit(0)).alias("a"), S.rate(F.lit(3), F.lit(20)).alias("b"), S.rounded(F.lit(2.5)).alias("c"), S.possession_factor(F.lit(50.0)).alias("d"),
        S.interpolated(F.lit(62.5), scoring.RATING_KNOTS).alias("e"), S.normal_cdf(F.lit(1.0)).alias("f"), S.normal_cdf(F.lit(-1.0)).alias("g"), S.folded_name(F.lit("  Éric  O'Neil-ßx ")).alias("h"),
        S.position_group(F.lit("Right Center Back")).alias("i"), S.position_group(F.lit(None).cast("string")).alias("j"), S.age_years(F.lit("1987-06-24").cast("date"), F.lit("2020-06-24").cast("date")).alias("k"),
        scoring.grade(F.lit(72.0)).alias("l"), scoring.grade(F.lit(0.0)).alias("m"), K.confidence(F.lit(5)).alias("n"), K.confidence(F.lit(None).cast("int")).alias("o"),
    )
    assert r["a"] is None and r["b"] == 13.5 and r["c"] == 3.0 and r["d"] == 1.0 and r["e"] == 74.0
    assert r["f"] == pytest.approx((1 + math.erf(1 / 2**0.5)) / 2, abs=1e-6) and r["f"] + r["g"] == pytest.approx(1)
    assert r["h"] == "eric oneilx" and r["i"] == "Center Back" and r["j"] == "Unknown" and r["k"] == 33.0
    assert (r["l"], r["m"], r["n"], r["o"]) == ("B+", "N/A", 0.5, 0.0)


def test_global_ranks_equal_windows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.5, float(rng.randint(0, 40))])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double")
    key = lambda r: (r[1] is not None, r[1] or 0, r[0])
    ordered = sorted(rows, key=key)
    tiles = {}
    for place, (i, _) in enumerate(ordered):
        size, extra = divmod(len(rows), 7)
        tiles[i] = place // (size + 1) + 1 if place < extra * (size + 1) else extra + (place - extra * (size + 1)) // size + 1
    got = {r["id"]: r["t"] for r in K.global_ntile(df.repartition(5), "v", "id", "t", 7).collect()}
    assert got == tiles
    below = {i: sum(key((0, w))[:2] < key((0, v))[:2] for _, w in rows) for i, v in rows}
    ranks = {r["id"]: r["p"] for r in K.global_percent_rank(df, "v", "p").collect()}
    assert all(ranks[i] == math.floor(below[i] / 499 * 100 * 10 + 0.5) / 10 for i in below)
    assert [r["p"] for r in K.global_percent_rank(df.limit(1), "v", "p").collect()] == [0.0]


def test_midranks_like_pandas(spark):
    import pandas as pd

    v = pd.Series([3.0, 1.0, 1.0, None, 2.0, 2.0, 2.0])
    want = ((v.rank(method="average") - 0.5) / len(v) * 100).fillna(0).round(6).tolist()
    df = spark.createDataFrame([(i, "g", None if x != x else x) for i, x in enumerate(v)], "id long, g string, v double")
    got = {r["id"]: r["v_mid"] for r in K.midrank_percentiles(df, ["g"], ["v"], ["id"]).collect()}
    assert [got[i] for i in range(7)] == pytest.approx(want, abs=1e-5)


def test_fragility_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"t{rng.randint(0, 5)}", f"p{rng.randint(0, 2)}", *[float(rng.randint(0, 100)) for _ in CAPS]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, team string, position string, " + ", ".join(f"{c} double" for c in CAPS))
    got = {r["id"]: r for r in teams.fragility(df, "id", ["team"], "position", CAPS).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for team in by.values():
        for r in team if len(team) > 1 else []:
            others = [x for x in team if x[0] != r[0]]
            mean = lambda rs, k: sum(x[3 + k] for x in rs) / len(rs)
            loss = {k: mean(team, k) - mean(others, k) for k in range(6) if mean(team, k) > mean(others, k)}
            best = max((sum((sum(x[3 + k] for x in others) + c[3 + k]) / len(team) - mean(others, k) for k in loss) for c in rows if c[0] != r[0] and c[2] == r[2] and sum(1 for t in by.values() for z in t if z[0] == c[0] and len(t) > 1)), default=0)
            deficit = sum(loss.values()) - max(0, best)
            assert got[r[0]]["deficit"] == pytest.approx(0.1 if deficit <= 0 else deficit, abs=2e-4)


def test_two_best_of_each_set_without_sorting_all_sums(spark):
    """Ties go by name; the sums of all members for all sets don't reach the window, only those above a bound."""
    rng = random.Random(5)
    rows = [(f"m{i:03}", rng.choice("ab"), *[float(rng.randint(0, 3)) for _ in CAPS]) for i in range(300)] + [("alone", "c", *[1.0] * 6)]
    df = spark.createDataFrame(rows, "c string, position string, " + ", ".join(f"{c} double" for c in CAPS))
    two = teams._two_best(df, "position", CAPS)
    got = {(r["position"], r["mask"], r["r"]): (r["c"], r["v"]) for r in two.collect()}
    want = {}
    for p in "abc":
        for m in range(64):
            ranked = sorted((-sum(x for i, x in enumerate(r[2:]) if m >> i & 1), r[0]) for r in rows if r[1] == p)
            want |= {(p, m, k + 1): (c, -v) for k, (v, c) in enumerate(ranked[:2])}
    assert got == want
    window = two._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1]
    assert "bound" in window and window.index("bound") < window.index("Generate explode")


def test_concentration_and_shares(spark, players):
    tall = teams.long_scores(players.withColumn("team", F.lit("T")), ["id", "team"], CAPS)
    for r in teams.concentration(tall, ["team"]).collect():
        assert 1e4 / 3 - 1e-6 <= r["hhi"] <= 1e4
    total = teams.shares(tall, ["team"], "id").groupBy("capability").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(100, abs=1e-3) for r in total)
    zero = tall.withColumn("score", F.lit(0.0))
    assert {r["hhi"] for r in teams.concentration(zero, ["team"]).collect()} == {0.0}


def test_traversal_stops_at_cycles(spark):
    e = spark.createDataFrame([("a", "1", "a", "2", "E", 1.0), ("a", "2", "a", "3", "E", 1.0), ("a", "3", "a", "1", "E", 1.0)], ", ".join(f"{c} {'double' if c == 'weight' else 'string'}" for c in G.EDGE))
    paths = {tuple(r["path"]) for r in G.traverse(e, spark.createDataFrame([("1",), ("9",)], ["node_id"]), None, 5).collect()}
    assert ("1", "2", "3") in paths and all(len(set(p)) == len(p) for p in paths)


def test_resolution(spark):
    e = spark.createDataFrame([(1, "Lionel Messi"), (2, "Leo Messina"), (3, "Pedri")], "key long, name string")
    index = text.name_index(e, "key", "name")
    m = spark.createDataFrame([("q", t) for t in ("messi", "pedri", "lion", "mess", "lionel messi", "goat")], "query string, token string")
    alias = spark.createDataFrame([("goat", 1)], "token string, key long")
    got = {r["token"]: (r["key"], r["n_candidates"]) for r in text.resolved(m, index, alias).collect()}
    assert got["pedri"] == (3, 1) and got["lion"] == (1, 1) and got["lionel messi"] == (1, 1) and got["goat"] == (1, 1) and got["mess"] == (None, 2)


def test_common_words_meet_their_mentions_once(spark):
    """A word of many names was paired with all of them in each text, and the index could be broadcast."""
    e = spark.createDataFrame([(i, ["Red Bolt", "Red Rod", "Blue Bolt"][i % 3]) for i in range(2, 302)] + [(1, "Red Gear"), (1, "Red Wheel")], "key long, name string")
    classes = text.name_classes(e, "key", "name")
    assert sorted(tuple(r) for r in classes.collect()) == [(1, "red gear", 1), (1, "red wheel", 1), (2, "blue bolt", 100), (3, "red bolt", 100), (4, "red rod", 100)]
    m = spark.createDataFrame([(q, t) for q in range(50) for t in ("red", "bolt", "gear", "red bolt", "wheels")], "query long, token string")
    whole = text.resolved(m, text.name_index(e, "key", "name"))
    for got in (whole, text.resolved(m, text.name_index(classes, "key", "name", size="size"))):
        want = {("red", None, 201), ("bolt", None, 200), ("gear", 1, 1), ("red bolt", None, 100)}
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((q, *w) for q in range(50) for w in want), key=str)
    assert {r["token"]: r["size"] for r in text.token_sizes(text.name_index(classes, "key", "name", size="size")).where("token IN ('red', 'red rod')").collect()} == {"red": 201, "red rod": 100}
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" not in plan


def test_questions(spark):
    rows = [("Messi vs Pedri",), ("Find a DM for Barcelona's squad",), ("what if we remove him",), ("hello",)]
    df = spark.createDataFrame(rows, ["q"]).select(text.normalized_query(F.col("q")).alias("n"), text.intent(F.col("q")).alias("i"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("Messi compare Pedri", "COMPARE_PLAYERS") and got[1] == ("Find a defensive midfielder for Barcelona squad", "TEAM_ANALYSIS")
    assert got[2][1] == "COUNTERFACTUAL" and got[3][1] == "GENERAL"


def test_quality_report(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (None, -1), (4, 200)], "id long, minute long")
    rules = [Q.null_rule("id"), Q.repeat_rule(["id"], ["minute"]), Q.range_rule("negative", F.col("minute") < 0), Q.range_rule("late", F.col("minute") > 150, "warning")]
    r = Q.report(df, rules, "events").first()
    assert (r["total"], r["clean"], r["errors"], r["warnings"], r["validity_pct"], r["is_valid"]) == (4, 2, 2, 1, 50.0, False)
    assert Q.report(df.where("id = 99"), rules, "events").first()["validity_pct"] == 0.0
    assert Q.missing_columns(df, ["id", "x"]) == ["x"] and Q.first_failures(df, rules, "minute").count() == 4


def test_json_normalisation(spark, tmp_path):
    (tmp_path / "events").mkdir()
    ev = [
        {"id": "a", "index": 1, "type": {"id": 35, "name": "Starting XI"}, "team": {"id": 1, "name": "T"}},
        {"id": "b", "index": 2, "type": {"id": 30, "name": "Pass"}, "location": [1, 2], "pass": {"length": 3.5, "end_location": [9, 8], "aerial_won": True}},
        {"id": "c", "index": 3, "type": {"id": 16, "name": "Shot"}, "under_pressure": True, "shot": {"statsbomb_xg": 0.1, "end_location": [120, 40, 1.5], "outcome": {"id": 1, "name": "Goal"}}},
    ]
    (tmp_path / "events" / "77.json").write_text(json.dumps(ev))
    (tmp_path / "events" / "notes.json").write_text("[]")
    (tmp_path / "events" / "78.json").write_text("{broken")
    raw = src.with_file_key(src.read_json_arrays(spark, str(tmp_path / "events"), N.schema(N.EVENT)), "match_id")
    got = {r["event_id"]: r for r in N.events(raw).where("event_id IS NOT NULL").collect()}
    assert got["a"]["match_id"] == 77 and got["a"]["pass_cross"] is None and got["a"]["under_pressure"] is False and got["a"]["player_id"] is None
    assert got["b"]["pass_end_x"] == 9.0 and got["b"]["pass_cross"] is False and got["b"]["aerial_won"] and got["b"]["pass_outcome"] is None
    assert got["c"]["shot_end_z"] == 1.5 and got["c"]["under_pressure"] and got["c"]["shot_outcome"] == "Goal"
    lineup = [{"team_id": 1, "team_name": "T", "lineup": [{"player_id": 5, "player_name": "P", "birth_date": "1990-02-30", "positions": [{"position": "Sub", "start_reason": "Sub"}, {"position": "Wing", "start_reason": "Starting XI"}]}, {"player_id": 6, "positions": []}]}]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "77.json").write_text(json.dumps(lineup))
    got = {r["player_id"]: r for r in N.lineups(src.with_file_key(src.read_json_arrays(spark, str(tmp_path / "l"), N.schema(N.LINEUP)), "match_id")).collect()}
    assert got[5]["starting_position"] == "Wing" and got[5]["birth_date"] is None and got[6]["starting_position"] is None


def test_store_and_fingerprint(spark, players, tmp_path):
    src.save(players, str(tmp_path / "p"), partition_by=["position"])
    src.save(players.limit(1), str(tmp_path / "p"), force=False)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    a = src.row_counts({"p": players})
    assert src.same_fingerprint(a, src.row_counts({"p": players}), {"v": "1"}, {"v": "1"}) and not src.same_fingerprint(a, src.row_counts({"p": players.limit(1)}), {}, {})
    assert src.load_summary(players, players.where("id < 3"), "id").first()["missing"] == 1


def test_streaming_counts(spark, tmp_path):
    from cohortry.streaming.match_counts import windowed_counts

    df = spark.createDataFrame([("a", "2024-01-01 00:01:00", 1, "Shot"), ("a", "2024-01-01 00:01:00", 1, "Shot"), ("b", "2024-01-01 00:02:00", 1, "Pass")], "event_id string, t string, m long, k string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", ["m"], "k")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["n_events"], r["n_shots"]) for r in spark.table("counts").collect()][-1] == (2, 1)
