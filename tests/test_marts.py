"""Marts over random matches against plain loops over the same rows."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortry.operators import marts
from cohortry.operators.cohort import cohort_percent_rank
from cohortry.operators.filters import where_all

EVENT = (
    "event_id string, match_id long, minute long, type_name string, team_id long, team_name string, player_id long, location_x double, location_y double, under_pressure boolean, "
    "pass_length double, pass_end_x double, pass_end_y double, pass_outcome string, pass_switch boolean, pass_through_ball boolean, pass_shot_assist boolean, pass_goal_assist boolean, pass_cross boolean, "
    "shot_statsbomb_xg double, shot_outcome string, shot_type string, carry_end_x double, carry_end_y double, dribble_outcome string, duel_type string, duel_outcome string, aerial_won boolean"
)
NAMES = [c.split()[0] for c in EVENT.split(", ")]
TEAMS = {7: "Harbour", 8: "Orchard", 9: "Quarry"}
GAMES = [(50, 7, 8, 3, 1), (51, 8, 9, 0, 0), (52, 9, 7, 2, 4), (53, 7, 8, 1, 2)]
PEOPLE = {11: (7, "Right Wing"), 12: (7, "Center Midfield"), 13: (8, "Center Forward"), 14: (8, "Left Back"), 15: (9, "Goalkeeper"), 16: (9, None)}


def half_up(x, digits):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def random_events():
    rng, rows = random.Random(20), []
    for match, home, away, _, _ in GAMES:
        for player, (team, _) in PEOPLE.items():
            if team not in (home, away) or (match, player) == (53, 16):
                continue
            for _ in range(rng.randint(12, 30)):
                kind = rng.choice(["Pass"] * 6 + ["Shot"] * 3 + ["Carry"] * 3 + ["Dribble", "Dribble", "Pressure", "Duel"])
                e = dict.fromkeys(NAMES) | {
                    "event_id": f"e{len(rows)}", "match_id": match, "minute": rng.randint(1, 93), "type_name": kind, "team_id": team, "team_name": TEAMS[team], "player_id": player, "location_x": rng.uniform(0, 110),
                    "location_y": rng.uniform(0, 80), "under_pressure": rng.random() < 0.3, "pass_switch": False, "pass_through_ball": False, "pass_shot_assist": rng.random() < 0.2, "pass_goal_assist": False,
                    "pass_cross": False, "aerial_won": False,
                }
                if kind == "Pass":
                    e |= {"pass_length": rng.uniform(2, 40), "pass_end_x": rng.uniform(0, 120), "pass_end_y": 40.0, "pass_outcome": rng.choice([None, None, None, "Incomplete", "Out"])}
                if kind == "Shot":
                    e |= {"shot_statsbomb_xg": rng.randint(1, 60) / 100, "shot_outcome": rng.choice(["Goal", "Saved", "Off T"]), "shot_type": rng.choice(["Open Play", "Open Play", "Penalty"])}
                if kind == "Carry":
                    e |= {"carry_end_x": rng.uniform(0, 120), "carry_end_y": rng.uniform(0, 80)}
                if kind == "Dribble":
                    e |= {"dribble_outcome": rng.choice(["Complete", "Incomplete"])}
                if kind == "Duel":
                    e |= {"duel_type": "Tackle", "duel_outcome": rng.choice(["Won", "Lost"])}
                rows.append(e)
    return rows


ROWS = random_events()


@pytest.fixture(scope="module")
def tables(spark):
    matches = spark.createDataFrame(
        [(m, 3, "Coast Cup", 1, "2031", h, TEAMS[h], a, TEAMS[a], x, y) for m, h, a, x, y in GAMES],
        "match_id long, competition_id long, competition_name string, season_id long, season_name string, home_team_id long, home_team_name string, away_team_id long, away_team_name string, home_score long, away_score long",
    )
    lineups = spark.createDataFrame(
        [(m, t, TEAMS[t], p, f"Player {p}", None, None, 180.0, 75.0, "Z", pos) for m, h, a, _, _ in GAMES for p, (t, pos) in PEOPLE.items() if t in (h, a)],
        "match_id long, team_id long, team_name string, player_id long, player_name string, player_nickname string, birth_date date, height_cm double, weight_kg double, country_name string, starting_position string",
    )
    return matches, spark.createDataFrame([tuple(r[c] for c in NAMES) for r in ROWS], EVENT), lineups


def of(**wanted):
    return [r for r in ROWS if all(r[k] == v for k, v in wanted.items())]


def test_match_summary(tables):
    rows = {r["match_id"]: r for r in marts.match_summary(*tables[:2]).collect()}
    assert [rows[m]["result"] for m in (50, 51, 52, 53)] == ["Home Win", "Draw", "Away Win", "Away Win"]
    assert [rows[m]["match_classification"] for m in (50, 51, 53)] == ["High Scoring", "Goalless", "Normal"]
    for m, h, a, _, _ in GAMES:
        passes = {t: len(of(match_id=m, team_id=t, type_name="Pass")) for t in (h, a)}
        assert (rows[m]["home_passes"], rows[m]["away_passes"]) == (passes[h], passes[a])
        assert rows[m]["home_xg"] == half_up(sum(r["shot_statsbomb_xg"] for r in of(match_id=m, team_id=h, type_name="Shot")) + 1e-12, 3)
        assert rows[m]["home_possession_pct"] == half_up(passes[h] * 100 / sum(passes.values()), 1)


def expected_minutes(player):
    total = 0
    for m, h, a, _, _ in GAMES:
        team, position = PEOPLE[player]
        own = of(match_id=m, player_id=player)
        if team in (h, a) and (position or own):
            last = max(r["minute"] for r in of(match_id=m))
            total += last if position else last - min(r["minute"] for r in own)
    return total


def test_player_summary(tables):
    rows = {r["player_id"]: r for r in marts.player_summary(*tables).collect()}
    assert set(rows) == set(PEOPLE)
    for p, r in rows.items():
        shots, passes = of(player_id=p, type_name="Shot"), of(player_id=p, type_name="Pass")
        goals = sum(s["shot_outcome"] == "Goal" for s in shots)
        accurate = sum(x["pass_outcome"] is None for x in passes)
        assert (r["goals"], r["total_passes"], r["accurate_passes"], r["minutes_played"]) == (goals, len(passes), accurate, expected_minutes(p))
        assert r["xg_total"] == pytest.approx(sum(s["shot_statsbomb_xg"] for s in shots), abs=6e-4) and r["npxg_total"] == pytest.approx(sum(s["shot_statsbomb_xg"] for s in shots if s["shot_type"] == "Open Play"), abs=6e-4)
        assert r["goals_p90"] == half_up(goals * 90 / expected_minutes(p), 3) and r["pass_accuracy_pct"] == half_up(accurate * 100 / len(passes), 1)
        carries = of(player_id=p, type_name="Carry")
        assert r["progressive_carries"] == sum(c["carry_end_x"] - c["location_x"] >= 10 for c in carries)
        assert r["total_carry_distance_m"] == pytest.approx(sum(math.hypot(c["carry_end_x"] - c["location_x"], c["carry_end_y"] - c["location_y"]) for c in carries), abs=0.06)
        means = defaultdict(list)
        for x in passes:
            means[x["match_id"]].append(x["pass_length"])
        # A match without a pass doesn't count in the mean of the matches' means.
        assert r["avg_pass_length_m"] == pytest.approx(sum(sum(v) / len(v) for v in means.values()) / len(means), abs=6e-3)
        assert r["position_name"] == PEOPLE[p][1] and r["secondary_position_name"] is None
    assert where_all(marts.player_summary(*tables), {"position_name": "Center Midfield", "team_name": None}).count() == 1
    assert where_all(marts.player_summary(*tables), minimum={"matches_played": 4}).isEmpty()


def test_team_summary(tables):
    rows = {r["team_name"]: r for r in marts.team_summary(*tables[:2]).collect()}
    harbour, quarry = rows["Harbour"], rows["Quarry"]
    assert (harbour["wins"], harbour["draws"], harbour["losses"], harbour["points"], harbour["goals_scored"], harbour["goal_difference"]) == (2, 0, 1, 6, 8, 3)
    assert (quarry["draws"], quarry["losses"], quarry["points"]) == (1, 1, 1)
    for t, name in TEAMS.items():
        games = [m for m, h, a, _, _ in GAMES if t in (h, a)]
        xg = lambda own: sum(r["shot_statsbomb_xg"] for r in ROWS if r["match_id"] in games and r["type_name"] == "Shot" and (r["team_id"] == t) == own)
        assert rows[name]["xg_for"] == pytest.approx(xg(True), abs=6e-4) and rows[name]["xg_against"] == pytest.approx(xg(False), abs=6e-4)


def test_percentiles_are_bounded(tables):
    p = cohort_percent_rank(marts.player_summary(*tables), ["team_name"], ["xg_p90", "goals_p90"], ["player_id"])
    assert all(0 <= r[c] <= 100 for r in p.collect() for c in ("xg_p90_pct", "goals_p90_pct"))


def test_empty_tables(tables):
    none = [t.where(F.lit(False)) for t in tables]
    assert marts.player_summary(*none).isEmpty() and marts.team_summary(*none[:2]).isEmpty()
