"""Names of any length, teams before players, and the state of conversations against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import dialogue as L
from cohortry.operators.text import name_index


def test_names_of_any_length_and_the_longest_of_those_that_hold_one_another(spark):
    names = [("real club de la costa blanca", 1), ("costa blanca", 2), ("costa blanca", 3), ("de la costa", 4), ("club", 5), ("blanca unida", 6)]
    texts = [(1, "Does Real Club de la Costa Blanca beat Costa Blanca?"), (2, "real club de la costa"), (3, None), (4, ""), (5, "costa blanca unida"), (6, "the costa"), (7, "Réal Clùb de la Costa, Blanca!")]
    got = L.whole_names(spark.createDataFrame(texts, "q int, t string"), "q", "t", spark.createDataFrame(names, "token string, key long"))
    assert {tuple(r) for r in got.collect()} == {
        (1, 2, 6, "real club de la costa blanca", 1), (1, 9, 2, "costa blanca", 2), (1, 9, 2, "costa blanca", 3), (2, 3, 3, "de la costa", 4),
        (5, 1, 2, "costa blanca", 2), (5, 1, 2, "costa blanca", 3), (5, 2, 2, "blanca unida", 6), (7, 1, 6, "real club de la costa blanca", 1),
    }
    none = L.whole_names(spark.createDataFrame(texts, "q int, t string"), "q", "t", spark.createDataFrame([("club", 5)], "token string, key long"))
    assert none.isEmpty() and none.columns == got.columns


def test_teams_before_players(spark):
    players = name_index(spark.createDataFrame([(1, "Bo Munich"), (2, "Ada Lima Costa Verde Rojo Azul"), (3, "Al Berlin")], "key long, name string"), "key", "name")
    teams = name_index(spark.createDataFrame([(1, "Munich"), (7, "United Berlin")], "key long, name string"), "key", "name")
    aliases = spark.createDataFrame([("ada", 2), ("bo", 1)], "token string, key long")
    names = players.where("kind = 1").select("token", "key").unionByName(teams.where("kind = 1").select("token", "key"))
    asked = [(1, "Munich and Bo"), (2, "Munich munich Munich Ada"), (3, "Ada Lima Costa Verde Rojo Azul against Al Berlin"), (4, "nobody"), (5, "united berlin or berlin and ada lima")]
    tokens = L.question_tokens(spark.createDataFrame(asked, "q int, t string"), "q", "t", names)
    got = {r["query"]: (r["players"], r["teams"]) for r in L.resolve_both(tokens, players, teams, aliases).collect()}
    # The second "berlin" names the team that was named before, so it may be a player.
    assert got == {1: ([1], [1]), 2: ([2], [1]), 3: ([2, 3], []), 5: ([3, 2], [7])}


def folded(turns):
    """State by state: turns in order, as dicts, to (intent, focus, other, reused, player_changed, team_changed)."""
    compared, pair, player, club, out = False, None, None, None, []
    for t in turns:
        low, found = (t["text"] or "").lower(), len(t["players"]) + len(t["teams"])
        intent, focus, other, reused = t["intent"], t["focus_player"], t["compare_player"], None
        if compared and pair and not found and any(w in low for w in L.PAIR_WORDS):
            (focus, other), reused, intent = pair, "pair", "COMPARE_PLAYERS"
        elif compared and pair and other is None and len(t["players"]) == 1 and any(w in low for w in L.SWAPS):
            focus, other, reused, intent = pair[0], t["players"][0], "swap", "COMPARE_PLAYERS"
        elif player is not None and not found and any(w in low for w in L.FOCUS_WORDS):
            focus, reused = player, "focus"
            intent = "PLAYER_ANALYSIS" if intent == "GENERAL" else intent
        before = player, club
        compared = intent == "COMPARE_PLAYERS"
        pair = (focus, other) if focus is not None and other is not None else pair
        player, club = focus if focus is not None else player, t["team"] if t["team"] is not None else club
        out.append((intent, focus, other, reused, focus is not None and focus != before[0], t["team"] is not None and t["team"] != before[1]))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_follow_ups_equal_a_fold(spark, partitions):
    rng = random.Random(partitions)
    kinds = [
        ("compare a and b", "COMPARE_PLAYERS", 2, 0), ("who is better?", "GENERAL", 0, 0), ("how about under pressure", "GENERAL", 0, 0), ("compare him with c", "COMPARE_PLAYERS", 1, 0),
        ("his strengths", "GENERAL", 0, 0), ("analyze d", "PLAYER_ANALYSIS", 1, 0), ("squad of e", "TEAM_ANALYSIS", 0, 1), ("compare them", "COMPARE_PLAYERS", 0, 0), ("hello", "GENERAL", 0, 0), (None, "GENERAL", 0, 0),
    ]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 9, 60])):
            text, intent, p, t = rng.choice(kinds)
            players, teams = rng.sample(range(5), p), rng.sample(range(3), t)
            rows.append((conv, turn, text, players, teams, intent, players[0] if players else None, players[1] if p == 2 else None, teams[0] if teams else None, "x"))
    schema = "conv long, turn long, text string, players array<long>, teams array<long>, intent string, focus_player long, compare_player long, team long, reused string"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    got = {(r["conv"], r["turn"]): tuple(r[c] for c in ("intent", "focus_player", "compare_player", "reused", "player_changed", "team_changed")) for r in L.followed_up(spark.createDataFrame(rows, schema).drop("reused"), "conv", "turn").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for conv in [*range(12), None]:
        own = [dict(zip([c.split()[0] for c in schema.split(", ")], r, strict=True)) for r in rows if r[0] == conv]
        assert [got[conv, t["turn"]] for t in own] == folded(own)
    assert {v[3] for v in got.values()} == {"pair", "swap", "focus", None}


def test_carried_values_cross_ranges(spark):
    df = spark.range(2000).select(F.lit("a").alias("k"), "id", F.when(F.col("id") % 500 == 3, F.col("id")).alias("v"))
    got = {r["id"]: r["last"] for r in L.carried(df, "k", "id", {"last": F.col("v")}).collect()}
    assert got == {i: None if i <= 3 else (i - 4) // 500 * 500 + 3 for i in range(2000)}


def test_tables_are_broadcast_only_if_counted_few(spark):
    """Spark takes exploded names for as small as their file, which sent the trie through the driver."""
    from cohortry.sources.tables import few

    left, names = spark.range(100), spark.range(50).toDF("id")
    plan = lambda right: left.join(right, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few(names)) and "BroadcastHashJoin" in plan(names)
    assert "BroadcastHashJoin" not in plan(few(names, 49)) and "SortMergeJoin" in plan(few(names, 49))
