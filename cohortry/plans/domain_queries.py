"""The football chain itself, registered over match tables derived from orders and their lines.

An order line is an event, 64 order keys are a match, a customer is a player who stands on one side of
each match. The derivation is a few SQL expressions that both engines read; the marts, vectors, profiles,
team profiles, graph and claims are the library's, and each query's SQL says anew what they should give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as DT

from cohortry.functions.scalar import POSITION_GROUPS, rounded
from cohortry.operators import cohort as K
from cohortry.operators import graph as G
from cohortry.operators import marts, normalize
from cohortry.operators import quality as Q
from cohortry.operators import scoring as S
from cohortry.operators import teams as T
from cohortry.sources.tables import new_folder, raw_records, read_json_arrays, stored, write_json_arrays

from . import football as P
from .base import div, midrank_sql, rnd, table

QUERIES, ORACLES = {}, {}


def register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


_MATCH = "CAST(floor(l_orderkey / 64e0) AS BIGINT)"
_HOME, _AWAY = "match_id % 20 + 1", "(match_id + 7) % 20 + 1"
GAMES = {
    "competition_id": "match_id % 3", "competition_name": "concat('League ', CAST(match_id % 3 AS VARCHAR(9)))", "season_id": "match_id % 2", "season_name": "concat('Season ', CAST(match_id % 2 AS VARCHAR(9)))",
    "home_team_id": _HOME, "home_team_name": f"concat('Team ', CAST({_HOME} AS VARCHAR(9)))", "away_team_id": _AWAY, "away_team_name": f"concat('Team ', CAST({_AWAY} AS VARCHAR(9)))",
    "home_score": "match_id % 5", "away_score": "match_id % 4",
}
_TYPES = ["Pass"] * 8 + ["Shot"] * 2 + ["Carry"] * 2 + ["Dribble", "Duel", "Pressure", "Ball Recovery", "Clearance", "Interception", "Dribbled Past", "Error"]
_KIND = "(l_partkey * 7 + l_linenumber * 3 + l_orderkey) % 20"
_TYPE = "CASE WHEN l_orderkey % 97 = 5 THEN 'Substitution' " + " ".join(f"WHEN {_KIND} = {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"
_TEAM = f"CASE WHEN o_custkey % 2 = 0 THEN {_HOME} ELSE {_AWAY} END"
EVENTS = {
    "player_id": "o_custkey", "team_id": _TEAM, "type_name": _TYPE, "minute": "CAST(l_quantity AS BIGINT) + 5 * l_linenumber", "under_pressure": "l_tax >= 0.06e0",
    "location_x": "CAST(l_partkey * 31 % 120 AS DOUBLE)", "location_y": "CAST(l_partkey * 17 % 80 AS DOUBLE)", "pass_length": "CAST(l_partkey % 40 AS DOUBLE)", "pass_end_x": "CAST(l_orderkey * 13 % 120 AS DOUBLE)",
    "pass_outcome": "CASE WHEN l_returnflag = 'R' THEN 'Incomplete' END", "pass_switch": "l_partkey % 13 = 0", "pass_through_ball": "l_partkey % 17 = 0", "pass_shot_assist": "l_partkey % 7 = 0",
    "pass_goal_assist": "l_partkey % 19 = 0", "pass_cross": "l_partkey % 11 = 0", "shot_statsbomb_xg": "l_discount", "shot_type": "CASE WHEN l_suppkey % 6 = 0 THEN 'Free Kick' ELSE 'Open Play' END",
    "shot_outcome": "CASE l_partkey % 5 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Saved' ELSE 'Off T' END", "carry_end_x": "CAST(l_orderkey * 29 % 120 AS DOUBLE)", "carry_end_y": "CAST(l_orderkey * 7 % 80 AS DOUBLE)",
    "dribble_outcome": "CASE WHEN l_returnflag = 'A' THEN 'Complete' ELSE 'Incomplete' END", "duel_type": "CASE WHEN l_orderkey % 2 = 0 THEN 'Tackle' ELSE 'Aerial Lost' END",
    "duel_outcome": "CASE WHEN l_partkey % 3 = 0 THEN 'Won' ELSE 'Lost' END", "aerial_won": "l_partkey % 6 = 0",
}
_POSITIONS = ["Goalkeeper", "Right Back", "Left Center Back", "Center Defensive Midfield", "Center Midfield", "Left Wing", "Center Forward", "Center Attacking Midfield"]
_POSITION = "CASE (player_id + match_id % 2) % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_POSITIONS)) + " END"

_BASE = f"""games AS (SELECT match_id, {', '.join(f'{v} AS {k}' for k, v in GAMES.items())} FROM (SELECT DISTINCT {_MATCH} AS match_id FROM lineitem)),
ev AS (SELECT match_id, {', '.join(f'{v} AS {k}' for k, v in EVENTS.items())} FROM (SELECT *, {_MATCH} AS match_id FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),
lu AS (SELECT DISTINCT match_id, player_id, team_id, concat('Team ', CAST(team_id AS VARCHAR(9))) AS team_name, {_POSITION} AS starting_position FROM ev)"""


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """matches, events and lineups."""
    spoken = lambda x: F.expr(x.replace("VARCHAR(9)", "STRING"))
    lines = table(spark, d, "lineitem").withColumn("match_id", spoken(_MATCH))
    matches = lines.select("match_id").distinct().withColumns({k: spoken(v) for k, v in GAMES.items()})
    events = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("match_id", *[spoken(v).alias(k) for k, v in EVENTS.items()])
    lineups = events.select("match_id", "player_id", "team_id").distinct().withColumns({"team_name": F.concat(F.lit("Team "), F.col("team_id").cast("string")), "starting_position": spoken(_POSITION)})
    nothing = {"player_nickname": "string", "height_cm": "double", "weight_kg": "double", "country_name": "string", "birth_date": "date"}
    lineups = lineups.withColumn("player_name", F.concat(F.lit("P"), F.col("player_id").cast("string"))).withColumns({k: F.lit(None).cast(v) for k, v in nothing.items()})
    return matches, events, lineups


def _count(c: str) -> str:
    return f"count(*) FILTER (WHERE {c})"


_SIDE = {"passes": "type_name = 'Pass'", "accurate_passes": "type_name = 'Pass' AND pass_outcome IS NULL", "shots": "type_name = 'Shot'", "shots_on_target": "type_name = 'Shot' AND shot_outcome IN ('Goal', 'Saved', 'Saved To Post')",
         "carries": "type_name = 'Carry'", "dribbles": "type_name = 'Dribble' AND dribble_outcome = 'Complete'", "events": "true", "events_under_pressure": "under_pressure"}
_SIDES = "side AS (SELECT match_id, team_id, " + ", ".join(f"{_count(c)} AS {k}" for k, c in _SIDE.items()) + f", {rnd(chr(39).join(['coalesce(sum(CASE WHEN type_name = ', 'Shot', ' THEN shot_statsbomb_xg END), 0e0)']), 3)} AS xg FROM ev GROUP BY 1, 2)"
_POSSESSION = lambda a, b: rnd(div(f"coalesce({a}.passes, 0) * 100e0", f"coalesce({a}.passes, 0) + coalesce({b}.passes, 0)"), 1)
_GAME = f"""ms AS (SELECT g.*, {', '.join(f'{s}.{k} AS {n}_{k}' for s, n in (('h', 'home'), ('a', 'away')) for k in [*_SIDE, 'xg'])}, {_POSSESSION('h', 'a')} AS home_possession_pct, {_POSSESSION('a', 'h')} AS away_possession_pct,
  CASE WHEN home_score > away_score THEN 'Home Win' WHEN home_score < away_score THEN 'Away Win' ELSE 'Draw' END AS result, CASE WHEN home_score + away_score >= 4 THEN 'High Scoring' WHEN home_score + away_score = 0 THEN 'Goalless' ELSE 'Normal' END AS match_classification
  FROM games g LEFT JOIN side h ON g.match_id = h.match_id AND g.home_team_id = h.team_id LEFT JOIN side a ON g.match_id = a.match_id AND g.away_team_id = a.team_id)"""
_GAME_OUT = ["match_id", "result", "match_classification", *[f"{n}_{k}" for n in ("home", "away") for k in [*_SIDE, "xg", "possession_pct"]]]


@register(f"WITH {_BASE}, {_SIDES}, {_GAME} SELECT {', '.join(_GAME_OUT)} FROM ms")
def match_mart(spark: SparkSession, d: str) -> DataFrame:
    """Match mart of both teams."""
    return marts.match_summary(*_tables(spark, d)[:2]).select(*_GAME_OUT)


_AERIAL = "type_name IN ('Pressure', 'Ball Recovery', 'Clearance', 'Duel', 'Interception', 'Dribbled Past', 'Error', 'Pass', 'Shot', 'Miscontrol') AND aerial_won"
_FACT = {
    "total_passes": "type_name = 'Pass'", "accurate_passes": "type_name = 'Pass' AND pass_outcome IS NULL", "crosses": "type_name = 'Pass' AND pass_cross", "switches": "type_name = 'Pass' AND pass_switch",
    "through_balls": "type_name = 'Pass' AND pass_through_ball", "shot_assists": "type_name = 'Pass' AND pass_shot_assist", "goal_assists": "type_name = 'Pass' AND pass_goal_assist",
    "progressive_passes": "type_name = 'Pass' AND pass_end_x > 60 AND pass_end_x > location_x AND pass_length >= 10", "total_shots": "type_name = 'Shot'", "goals": "type_name = 'Shot' AND shot_outcome = 'Goal'",
    "shots_on_target": _SIDE["shots_on_target"], "total_carries": "type_name = 'Carry'", "progressive_carries": "type_name = 'Carry' AND carry_end_x - location_x >= 10", "total_dribbles": "type_name = 'Dribble'",
    "dribbles_completed": _SIDE["dribbles"], "pressures": "type_name = 'Pressure'", "ball_recoveries": "type_name = 'Ball Recovery'", "clearances": "type_name = 'Clearance'", "tackles": "type_name = 'Duel' AND duel_type = 'Tackle'",
    "tackles_won": "type_name = 'Duel' AND duel_type = 'Tackle' AND duel_outcome IN ('Won', 'Success In Play', 'Success Out')", "interceptions": "type_name = 'Interception'", "dribbled_past": "type_name = 'Dribbled Past'",
    "errors_leading_to_shot": "type_name = 'Error'", "aerials_won": _AERIAL, "aerials_total": f"({_AERIAL}) OR (type_name = 'Duel' AND duel_type = 'Aerial Lost')", "total_events": "true", "events_under_pressure": "under_pressure",
}
_FACTS = f"""facts AS (SELECT match_id, player_id, {', '.join(f'{_count(c)} AS {k}' for k, c in _FACT.items())}, avg(CASE WHEN type_name = 'Pass' THEN pass_length END) AS avg_pass_length_m,
  sum(CASE WHEN type_name = 'Shot' THEN shot_statsbomb_xg END) AS xg_total, sum(CASE WHEN type_name = 'Shot' AND shot_type NOT IN ('Free Kick', 'Penalty') THEN shot_statsbomb_xg END) AS npxg_total,
  sum(CASE WHEN type_name = 'Carry' THEN sqrt((carry_end_x - location_x) * (carry_end_x - location_x) + (carry_end_y - location_y) * (carry_end_y - location_y)) END) AS total_carry_distance_m,
  min(CASE WHEN type_name IN ('Substitution', 'Player Off') THEN minute END) AS sub_off, min(minute) AS first_event FROM ev GROUP BY 1, 2)"""


@register(f"WITH {_BASE}, {_FACTS} SELECT match_id, player_id, {', '.join(_FACT)}, {rnd('avg_pass_length_m', 3)} AS length, {rnd('xg_total', 3)} AS xg, {rnd('npxg_total', 3)} AS npxg, {rnd('total_carry_distance_m', 2)} AS carried, sub_off, first_event FROM facts")
def player_match_mart(spark: SparkSession, d: str) -> DataFrame:
    """All facts of a player in a match."""
    f = marts.player_match_facts(_tables(spark, d)[1])
    return f.select("match_id", "player_id", *_FACT, rounded(F.col("avg_pass_length_m"), 3).alias("length"), rounded(F.col("xg_total"), 3).alias("xg"), rounded(F.col("npxg_total"), 3).alias("npxg"), rounded(F.col("total_carry_distance_m"), 2).alias("carried"), "sub_off", "first_event")


_PADJ = {"pressures": "padj_pressures", "ball_recoveries": "padj_recoveries", "clearances": "padj_clearances", "tackles": "padj_tackles", "interceptions": "padj_interceptions"}
_P90 = {
    "goals_p90": ("goals", 3), "npxg_p90": ("npxg_total", 3), "passes_p90": ("total_passes", 2), "carry_distance_p90": ("total_carry_distance_m", 1), "progressive_passes_p90": ("progressive_passes", 2), "progressive_carries_p90": ("progressive_carries", 2),
    "switches_p90": ("switches", 3), "crosses_p90": ("crosses", 3), "through_balls_p90": ("through_balls", 3), "shot_assists_p90": ("shot_assists", 3), "goal_assists_p90": ("goal_assists", 3), "pressures_p90": ("padj_pressures", 2),
    "recoveries_p90": ("padj_recoveries", 2), "clearances_p90": ("padj_clearances", 2), "tackles_p90": ("padj_tackles", 2), "interceptions_p90": ("padj_interceptions", 2), "tackles_won_p90": ("tackles_won", 2), "dribbled_past_p90": ("dribbled_past", 2),
    "errors_leading_to_shot_p90": ("errors_leading_to_shot", 3), "aerials_won_p90": ("aerials_won", 2), "aerials_total_p90": ("aerials_total", 2), "events_under_pressure_p90": ("events_under_pressure", 2),
}
_SHARES = {"pass_accuracy_pct": ("accurate_passes", "total_passes"), "shot_accuracy_pct": ("shots_on_target", "total_shots"), "dribble_success_pct": ("dribbles_completed", "total_dribbles"), "pressure_pct": ("events_under_pressure", "total_events")}
_SEASON = f"""{_SIDES}, {_GAME}, {_FACTS}, dur AS (SELECT match_id, max(minute) AS duration FROM ev GROUP BY 1),
app AS (SELECT l.*, f.* EXCLUDE (match_id, player_id), m.competition_name, m.season_name, CASE WHEN starting_position IS NOT NULL THEN coalesce(sub_off, duration) ELSE duration - first_event END AS mins,
  2e0 / (1e0 + exp(-0.1e0 * (CASE WHEN l.team_name = m.home_team_name THEN home_possession_pct ELSE away_possession_pct END - 50e0))) AS factor
  FROM lu l JOIN ms m USING (match_id) LEFT JOIN dur USING (match_id) LEFT JOIN facts f USING (match_id, player_id) WHERE starting_position IS NOT NULL OR first_event IS NOT NULL),
pc AS (SELECT player_id, competition_name, season_name, starting_position AS pos, count(*) AS n FROM app WHERE starting_position IS NOT NULL GROUP BY 1, 2, 3, 4),
pr AS (SELECT *, row_number() OVER w AS r, sum(n) OVER (PARTITION BY player_id, competition_name, season_name) AS t FROM pc WINDOW w AS (PARTITION BY player_id, competition_name, season_name ORDER BY n DESC, pos)),
pp AS (SELECT player_id, competition_name, season_name, max(pos) FILTER (WHERE r = 1) AS position_name, max(pos) FILTER (WHERE r = 2) AS secondary_position_name, count(*) AS positions_played_count FROM pr GROUP BY 1, 2, 3),
agg AS (SELECT player_id, team_name, competition_name, season_name, count(DISTINCT match_id) AS matches_played, CAST(sum(mins) AS BIGINT) AS minutes_played, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in _FACT)},
  {', '.join(f'coalesce(sum({c} * factor), 0e0) AS {a}' for c, a in _PADJ.items())}, {rnd('coalesce(avg(avg_pass_length_m), 0e0)', 2)} AS avg_pass_length_m, {rnd('coalesce(sum(xg_total), 0e0)', 3)} AS xg_total,
  {rnd('coalesce(sum(npxg_total), 0e0)', 3)} AS npxg_total, {rnd('coalesce(sum(total_carry_distance_m), 0e0)', 1)} AS total_carry_distance_m FROM app GROUP BY 1, 2, 3, 4),
ps AS (SELECT a.*, position_name, secondary_position_name, coalesce(positions_played_count, 1) AS positions_played_count, {', '.join(f"{rnd(div(f'{a} * 100e0', b), 1)} AS {k}" for k, (a, b) in _SHARES.items())},
  {rnd('goals - xg_total', 3)} AS goals_minus_xg, {rnd(div('xg_total', 'total_shots'), 3)} AS xg_per_shot, {', '.join(f"{rnd(div(f'{c} * 90e0', 'minutes_played'), n)} AS {k}" for k, (c, n) in _P90.items())}
  FROM agg a LEFT JOIN pp USING (player_id, competition_name, season_name))"""
_SEASON_OUT = ["player_id", "team_name", "competition_name", "season_name", "matches_played", "minutes_played", *_FACT, *_SHARES, "goals_minus_xg", "xg_per_shot", *_P90, "avg_pass_length_m", "position_name", "secondary_position_name", "positions_played_count"]


@register(f"WITH {_BASE}, {_SEASON} SELECT {', '.join(_SEASON_OUT)} FROM ps")
def player_mart(spark: SparkSession, d: str) -> DataFrame:
    """Player mart of a competition and season."""
    return marts.player_summary(*_tables(spark, d)).select(*_SEASON_OUT)


_TEAM_OUT = ["team_id", "competition_name", "season_name", "matches_played", "wins", "draws", "losses", "points", "goals_scored", "goals_conceded", "goal_difference", "xg_for", "xg_against", "total_shots", "shots_conceded", "total_passes", "pass_accuracy_pct"]


@register(f"""WITH {_BASE}, own AS (SELECT match_id, team_id, coalesce(sum(CASE WHEN type_name = 'Shot' THEN shot_statsbomb_xg END), 0e0) AS xg, {_count(_SIDE['shots'])} AS shots, {_count(_SIDE['passes'])} AS passes, {_count(_SIDE['accurate_passes'])} AS accurate FROM ev GROUP BY 1, 2),
s AS (SELECT match_id, competition_name, season_name, home_team_id AS team_id, away_team_id AS rival, home_score AS f, away_score AS c FROM games UNION ALL SELECT match_id, competition_name, season_name, away_team_id, home_team_id, away_score, home_score FROM games)
SELECT s.team_id, competition_name, season_name, count(*) AS matches_played, {_count('f > c')} AS wins, {_count('f = c')} AS draws, {_count('f < c')} AS losses, {_count('f > c')} * 3 + {_count('f = c')} AS points, CAST(sum(f) AS BIGINT) AS goals_scored, CAST(sum(c) AS BIGINT) AS goals_conceded,
  CAST(sum(f) - sum(c) AS BIGINT) AS goal_difference, {rnd('sum(o.xg)', 3)} AS xg_for, {rnd('sum(r.xg)', 3)} AS xg_against, CAST(sum(o.shots) AS BIGINT) AS total_shots, CAST(sum(r.shots) AS BIGINT) AS shots_conceded, CAST(sum(o.passes) AS BIGINT) AS total_passes,
  {rnd(div('sum(o.accurate) * 100e0', 'sum(o.passes)'), 1)} AS pass_accuracy_pct FROM s LEFT JOIN own o ON s.match_id = o.match_id AND s.team_id = o.team_id LEFT JOIN own r ON s.match_id = r.match_id AND s.rival = r.team_id GROUP BY 1, 2, 3""")
def team_mart(spark: SparkSession, d: str) -> DataFrame:
    """Team table of a competition and season."""
    return marts.team_summary(*_tables(spark, d)[:2]).select(*_TEAM_OUT)


# Profiles of competition vectors

_GROUP = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(position_name), {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{g}'" for parts, g in POSITION_GROUPS) + " ELSE 'Unknown' END"
_W = "least(greatest((minutes_played - 90e0) / 810e0, 0e0), 1e0)"


def _inverted(w: dict[str, float]) -> str:
    return " + ".join(f"(100e0 - p_{m}) * {v}e0" if m in P.NEGATIVE else f"p_{m} * {v}e0" for m, v in w.items())


#: The role labels and when they hold, in order.
_LABEL_RULES = [
    ("attacking_threat >= 85", "Elite Goal Scorer"), ("chance_creation >= 80 AND ball_progression >= 65", "Creative Playmaker"), ("ball_security >= 80 AND ball_progression >= 75", "Deep-Lying Playmaker"),
    ("ball_progression >= 70 AND defensive_activity >= 70", "Box-to-Box Midfielder"), ("ball_progression >= 75 AND chance_creation >= 65 AND position_group = 'Fullback'", "Progressive Fullback"),
    ("defensive_activity >= 85 AND ball_security >= 70", "Defensive Specialist"), ("press_resistance >= 85 AND ball_security >= 75", "Press-Resistant Anchor"), ("defensive_activity >= 80 AND tactical_versatility >= 65", "High-Energy Presser"),
    ("tactical_versatility >= 85", "Versatile Asset"), (f"least({', '.join(P.CAPABILITIES)}) >= 40 AND {' + '.join(f'CASE WHEN {c} >= 60 THEN 1 ELSE 0 END' for c in P.CAPABILITIES)} >= 4", "All-Round Contributor"),
]
_LOW, _POS = "matches_played < 8", "CASE WHEN positions_played_count >= 4 THEN 100e0 WHEN positions_played_count = 3 THEN 70e0 WHEN positions_played_count = 2 THEN 40e0 ELSE 0e0 END"
_BALANCE = "CASE WHEN greatest(attacking_threat, defensive_activity) > 0 THEN least(attacking_threat, defensive_activity) / greatest(attacking_threat, defensive_activity) * 100e0 ELSE 0e0 END"
_CAPS = P.CAPABILITIES
_PROFILE = f"""{_SEASON}, v AS (SELECT player_id, team_name, competition_name AS competition, season_name AS season, {_GROUP} AS position_group, minutes_played, matches_played, positions_played_count, {', '.join(f'coalesce(CAST({m} AS DOUBLE), 0e0) AS {m}' for m in P.METRICS)} FROM ps),
sh AS (SELECT *, {', '.join(f'{m} * {_W} + avg({m}) OVER (PARTITION BY position_group) * (1e0 - {_W}) AS s_{m}' for m in P.METRICS)} FROM v),
pt AS (SELECT *, {', '.join(f"{midrank_sql(f's_{m}', 'position_group')} AS p_{m}" for m in P.METRICS)} FROM sh),
cp AS (SELECT *, {', '.join(f"{rnd(' + '.join(f'p_{m} * {w}e0' for m, w in ws.items()), 6)} AS {c}" for c, ws in P.WEIGHTS.items())}, {rnd(f'greatest({_inverted(P.ACTIVE)}, {_inverted(P.CONTROLLING)})', 6)} AS defensive_activity FROM pt),
vs AS (SELECT *, {rnd(f'CASE WHEN {_LOW} THEN ({_POS}) * 0.1e0 + 50e0 * 0.55e0 + ({_BALANCE}) * 0.35e0 ELSE ({_POS}) * 0.25e0 + 50e0 * 0.4e0 + ({_BALANCE}) * 0.35e0 END', 4)} AS tactical_versatility,
  {rnd('least(100e0, matches_played / 38e0 * 60e0 + 50e0 * 0.4e0)', 4)} AS availability_rating FROM cp),
lb AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for c, n in _LABEL_RULES)} ELSE 'Developing Profile' END AS role_label FROM vs)"""
_KEY = ["player_id", "team_name", "competition", "season", "position_group"]


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return P.profiles(spark, P.vectors(marts.player_summary(*_tables(spark, d))))


@register(f"WITH {_BASE}, {_PROFILE} SELECT {', '.join(_KEY)}, {', '.join(f'{rnd(c, 4)} AS {c}' for c in _CAPS)}, tactical_versatility, availability_rating, role_label FROM lb")
def capability_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Shrinkage, percentiles, capabilities, attributes and role label of every vector."""
    return _profiles(spark, d).select(*_KEY, *[rounded(F.col(c), 4).alias(c) for c in _CAPS], "tactical_versatility", "availability_rating", "role_label")


_T = "arch(grp, template, " + ", ".join(f"t_{c}" for c in _CAPS) + ") AS (VALUES " + ", ".join(f"('{g}', '{n}', {', '.join(f'{float(x)}e0' for x in s)})" for g, n, *s in P.ARCHETYPES) + ")"
_DOT, _NA, _NB = (" + ".join(f"{a}{c} * {b}{c}" for c in _CAPS) for a, b in (("q_", "t_"), ("q_", "q_"), ("t_", "t_")))
_NEAR = rnd(f"coalesce(({_DOT}) / nullif(sqrt({_NA}) * sqrt({_NB}), 0e0), 0e0) * 0.75e0 + greatest(0e0, 1e0 - sqrt({' + '.join(f'(q_{c} - t_{c}) * (q_{c} - t_{c})' for c in _CAPS)}) / 245e0) * 0.25e0", 6)
_ARCHETYPES = f"""{_T}, st AS (SELECT {', '.join(_KEY)}, {', '.join(f"{midrank_sql(c, 'position_group')} AS q_{c}" for c in _CAPS)}, greatest({', '.join(_CAPS)}) AS most FROM lb),
sm AS (SELECT st.*, template, {_NEAR} AS similarity FROM st LEFT JOIN (SELECT DISTINCT grp AS known FROM arch) ON known = position_group JOIN arch ON known IS NULL OR arch.grp = known),
bt AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEY)} ORDER BY similarity DESC, template) AS r FROM sm),
ar AS (SELECT {', '.join(_KEY)}, CASE WHEN position_group = 'Goalkeeper' THEN 'Goalkeeper' WHEN most = 0 OR similarity < 0.3e0 THEN 'Unknown' ELSE template END AS archetype, similarity FROM bt WHERE r = 1)"""


@register(f"WITH {_BASE}, {_PROFILE}, {_ARCHETYPES} SELECT {', '.join(_KEY)}, archetype, {rnd('CASE WHEN archetype = $$Unknown$$ THEN 0e0 ELSE similarity END', 4)} AS weight FROM ar WHERE archetype <> 'Unknown'")
def archetype_edges(spark: SparkSession, d: str) -> DataFrame:
    """The archetype of each profile, with its confidence as the edge's weight."""
    return _profiles(spark, d).where("archetype <> 'Unknown' OR archetype_confidence > 0").select(*_KEY, "archetype", rounded(F.col("archetype_confidence"), 4).alias("weight"))


_TEAM_KEYS = "team_name, competition, season"
_SQUAD = f"mn AS (SELECT {_TEAM_KEYS}, count(*) AS squad_size, {', '.join(f'{rnd(f'avg({c})', 1)} AS {c}' for c in _CAPS)} FROM lb GROUP BY 1, 2, 3), tl AS (SELECT {_TEAM_KEYS}, player_id, capability, score FROM lb UNPIVOT (score FOR capability IN ({', '.join(_CAPS)})))"
_HHI = f"hh AS (SELECT {_TEAM_KEYS}, capability, coalesce({rnd('1e4 * sum(CASE WHEN score > 0 THEN score * score END) / (sum(CASE WHEN score > 0 THEN score END) * sum(CASE WHEN score > 0 THEN score END))', 4)}, 0e0) AS hhi FROM tl GROUP BY 1, 2, 3, 4)"
_NECKS = "bn AS (" + " UNION ALL ".join(f"SELECT {_TEAM_KEYS}, '{u}' AS upstream, '{v}' AS downstream, {rnd(f'{u} - {v}', 1)} AS severity FROM mn WHERE {u} - {v} > 20" for u, v in P.BOTTLENECKS) + ")"


def _team_parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return P.team_profiles(_profiles(spark, d))


@register(f"""WITH {_BASE}, {_PROFILE}, {_SQUAD}, {_HHI}, {_NECKS}
SELECT {_TEAM_KEYS}, 'HAS_SQUAD_CAPABILITY' AS edge_type, capability AS target_id, {rnd('score / 100e0', 4)} AS weight FROM mn UNPIVOT (score FOR capability IN ({', '.join(_CAPS)}))
UNION ALL SELECT {_TEAM_KEYS}, 'HAS_CONCENTRATION', capability, {rnd('hhi / 10000e0', 4)} FROM hh UNION ALL SELECT {_TEAM_KEYS}, 'HAS_BOTTLENECK', downstream, {rnd('severity / 100e0', 4)} FROM bn
UNION ALL SELECT {_TEAM_KEYS}, 'BOTTLENECKS_INTO', upstream || '>' || downstream, {rnd('severity / 100e0', 4)} FROM bn""")
def team_edges(spark: SparkSession, d: str) -> DataFrame:
    """Squad capabilities, concentrations and bottlenecks as edges of teams."""
    t = _team_parts(spark, d)
    edge = lambda df, kind, target, weight: df.select(*P.TEAM, F.lit(kind).alias("edge_type"), target.alias("target_id"), rounded(weight, 4).alias("weight"))
    squad = T.long_scores(t["means"], P.TEAM, _CAPS)
    out = edge(squad, "HAS_SQUAD_CAPABILITY", F.col("capability"), F.col("score") / 100.0)
    out = out.unionByName(edge(t["concentration"], "HAS_CONCENTRATION", F.col("capability"), F.col("hhi") / 10000.0))
    out = out.unionByName(edge(t["bottlenecks"], "HAS_BOTTLENECK", F.col("downstream"), F.col("severity") / 100.0))
    return out.unionByName(edge(t["bottlenecks"], "BOTTLENECKS_INTO", F.concat_ws(">", "upstream", "downstream"), F.col("severity") / 100.0))


_LOST = " + ".join(f"greatest(m_{c} - r_{c}, 0e0)" for c in _CAPS)
_FRAGILE = f"""nn AS (SELECT *, count(*) OVER w AS n, {', '.join(f'(sum({c}) OVER w - {c}) / nullif(count(*) OVER w - 1, 0) AS r_{c}, avg({c}) OVER w AS m_{c}' for c in _CAPS)} FROM lb WINDOW w AS (PARTITION BY {_TEAM_KEYS})),
ff AS (SELECT *, {_LOST} AS lost FROM nn WHERE n >= 2),
gn AS (SELECT l.team_name, l.competition, l.season, l.player_id, max({' + '.join(f'CASE WHEN {rnd(f'l.m_{c} - l.r_{c}', 9)} > 0 THEN p.{c} - l.r_{c} ELSE 0e0 END' for c in _CAPS)}) AS gain FROM ff l JOIN ff p ON l.position_group = p.position_group AND (l.player_id, l.team_name, l.competition, l.season) <> (p.player_id, p.team_name, p.competition, p.season) GROUP BY 1, 2, 3, 4),
dd AS (SELECT f.team_name, f.competition, f.season, f.player_id, lost, lost - greatest(0e0, coalesce(gain / n, 0e0)) AS raw FROM ff f LEFT JOIN gn USING (team_name, competition, season, player_id)),
fr AS (SELECT * EXCLUDE (raw), {rnd(f'CASE WHEN {rnd("raw", 4)} <= 0 THEN 0.1e0 ELSE raw END', 4)} AS deficit FROM dd)"""


def _fragile(spark: SparkSession, d: str) -> DataFrame:
    squad = _profiles(spark, d).withColumn("member", F.concat_ws("|", "player_id", *P.TEAM))
    return T.fragility(squad, "member", P.TEAM, "position_group", _CAPS).withColumn("player_id", F.split("member", r"\|")[0].cast("long"))


@register(f"WITH {_BASE}, {_PROFILE}, {_FRAGILE} SELECT {_TEAM_KEYS}, player_id, {rnd('least(1e0, deficit / 100e0)', 3)} AS weight FROM fr")
def fragility_edges(spark: SparkSession, d: str) -> DataFrame:
    """What each team would miss in each member, as edges."""
    return _fragile(spark, d).select(*P.TEAM, "player_id", rounded(F.least(F.lit(1.0), F.col("deficit") / 100.0), 3).alias("weight"))


_ZS = f"zz AS (SELECT {_TEAM_KEYS}, {', '.join(f'(avg({c}) - (SELECT avg({c}) FROM lb)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END FROM lb) AS z_{c}' for c in _CAPS)} FROM lb GROUP BY 1, 2, 3)"
_STYLED = "sy AS (" + " UNION ALL ".join(
    f"SELECT {_TEAM_KEYS}, '{n}' AS style, {rnd('coalesce((' + ' + '.join(f'z_{c} * {float(x)}e0' for c, x in zip(_CAPS, v, strict=True)) + ') / nullif(sqrt(' + ' + '.join(f'z_{c} * z_{c}' for c in _CAPS) + f') * {sum(x * x for x in v) ** 0.5!r}, 0e0), 0e0)', 6)} AS similarity FROM zz" for n, v in P.STYLES.items()
) + f"), sr AS (SELECT *, row_number() OVER (PARTITION BY {_TEAM_KEYS} ORDER BY similarity DESC, style) AS k FROM sy), tid AS (SELECT {_TEAM_KEYS}, max(CASE WHEN k = 1 THEN CASE WHEN similarity > 0.6 THEN style ELSE 'Balanced' END END) AS one, max(CASE WHEN k = 2 AND similarity > 0.75 THEN style END) AS two FROM sr GROUP BY 1, 2, 3)"


@register(f"""WITH {_BASE}, {_PROFILE}, {_SQUAD}, {_HHI}, {_NECKS}, {_ZS}, {_STYLED}
SELECT {_TEAM_KEYS}, 'identity' AS claim_type, one AS subject, CASE WHEN two IS NOT NULL THEN 75e0 WHEN one <> 'Balanced' THEN 60e0 ELSE 40e0 END AS strength FROM tid
UNION ALL SELECT {_TEAM_KEYS}, 'bottleneck', upstream || '>' || downstream, {rnd('100e0 - least(severity, 100e0)', 2)} FROM bn UNION ALL SELECT {_TEAM_KEYS}, 'concentration', capability, {rnd('greatest(0e0, 100e0 - hhi / 50e0)', 2)} FROM hh WHERE hhi > 2500""")
def team_statements(spark: SparkSession, d: str) -> DataFrame:
    """Identity, bottleneck and concentration claims of teams."""
    c = P.team_claims(_team_parts(spark, d)).where("claim_type <> 'fragility'")
    return c.withColumn("strength", rounded(F.col("strength"), 2))


@register(f"""WITH {_BASE}, {_PROFILE}, {_FRAGILE}, rk AS (SELECT {_TEAM_KEYS}, player_id, {rnd('deficit', 2)} AS strength, row_number() OVER (PARTITION BY {_TEAM_KEYS} ORDER BY {rnd('deficit', 2)} DESC, player_id) AS rank FROM fr)
SELECT * FROM rk WHERE rank <= 5""")
def fragility_claims(spark: SparkSession, d: str) -> DataFrame:
    """The five members each team would miss most (P5): a top-k by team."""
    f = _fragile(spark, d).select(*P.TEAM, "player_id", rounded(F.col("deficit"), 2).alias("strength"))
    return K.top_k(f, P.TEAM, [F.desc("strength"), F.col("player_id")], 5)


# Raw checks and a squad's age

@register(f"""WITH {_BASE}, j AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT 'missing_keys_event' AS rule, count(*) FILTER (WHERE k IS NULL OR event_type IS NULL) AS broken, count(*) AS total FROM j
UNION ALL SELECT 'teams_not_2', count(*) FILTER (WHERE n <> 2), count(*) FROM (SELECT match_id, count(DISTINCT team_id) AS n FROM lu GROUP BY 1)
UNION ALL SELECT 'missing_position_first_20_files', count(*) FILTER (WHERE starting_position IS NULL), count(*) FROM lu WHERE match_id IN (SELECT DISTINCT match_id FROM lu ORDER BY 1 LIMIT 20)""")
def raw_checks(spark: SparkSession, d: str) -> DataFrame:
    """Required keys of records, two teams a match, and a validation of the first twenty files only."""
    parsed = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    _, _, lineups = _tables(spark, d)
    row = lambda df, name, broken: df.agg(F.count_if(broken).alias("broken"), F.count("*").alias("total")).select(F.lit(name).alias("rule"), "broken", "total")
    rule = Q.required_rule("event", ["k", "event_type"])
    wrong = Q.group_sizes(lineups, "match_id", "team_id", 2).agg(F.count("*").alias("broken"))
    pairs = wrong.crossJoin(lineups.agg(F.countDistinct("match_id").alias("total"))).select(F.lit("teams_not_2").alias("rule"), "broken", "total")  # one row each
    sample = Q.first_files(lineups, "match_id")
    return row(parsed, rule.name, rule.broken).unionByName(pairs).unionByName(row(sample, "missing_position_first_20_files", F.col("starting_position").isNull()))


_EDGE = "SELECT '{0}' AS edge_type, CAST({1} AS VARCHAR) AS source_id, {2} AS target_id, {3} AS weight FROM {4}"
_REQUIRED = [(n, c, w) for n, weights in P.WEIGHTS.items() for c, w in weights.items()]
_VALUED = [(n, c, v) for n, values in P.STYLES.items() for c, v in zip(_CAPS, values, strict=True)]


@register(f"""WITH {_BASE}, {_PROFILE}, {_ARCHETYPES}, rq(a, b, w) AS (VALUES {', '.join(f"('{a}', '{b}', {w}e0)" for a, b, w in _REQUIRED)}), vl(a, b, w) AS (VALUES {', '.join(f"('{a}', '{b}', {float(w)}e0)" for a, b, w in _VALUED)})
{_EDGE.format('SEASON_OF', 'player_id', "concat(competition, '|', season, '|', team_name)", '1e0', 'lb')} UNION ALL {_EDGE.format('CAREER_OF', 'player_id', "CAST(count(*) AS VARCHAR)", '1e0', 'lb')} GROUP BY player_id
UNION ALL {_EDGE.format('POSTED_METRIC', "concat(CAST(player_id AS VARCHAR), '|', competition, '|', season, '|', team_name)", "'goals_p90'", rnd('goals_p90', 3), 'lb')} WHERE goals_p90 > 0
UNION ALL SELECT 'REQUIRES', a, b, w FROM rq UNION ALL SELECT 'VALUES', a, b, w FROM vl
UNION ALL SELECT 'SUPERSEDES', CAST(player_id AS VARCHAR), concat(max(season), '>', min(season)), 1e0 FROM lb GROUP BY player_id HAVING count(DISTINCT season) > 1
UNION ALL SELECT 'FITS_STYLE', concat(CAST(player_id AS VARCHAR), '|', competition, '|', season, '|', team_name), 'High Press', {rnd('(defensive_activity * 0.6e0 + press_resistance * 0.4e0) / 100e0', 4)} FROM lb""")
def declared_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are declared beside those built: levels, metrics, requirements, values, successions, fits."""
    p = _profiles(spark, d)
    where = F.concat_ws("|", "competition", "season", "team_name")
    whole = F.concat_ws("|", F.col("player_id").cast("string"), where)
    edge = lambda df, kind, source, target, weight: df.select(F.lit(kind).alias("edge_type"), source.alias("source_id"), target.alias("target_id"), weight.cast("double").alias("weight"))
    player = F.col("player_id").cast("string")
    seasons = p.groupBy("player_id").agg(F.count("*").alias("n"), F.max("season").alias("last"), F.min("season").alias("first"), F.countDistinct("season").alias("kinds"))
    fixed = lambda kind, rows: edge(spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "a string, b string, w double"), kind, F.col("a"), F.col("b"), F.col("w"))
    parts = [
        edge(p, "SEASON_OF", player, where, F.lit(1.0)), edge(seasons, "CAREER_OF", player, F.col("n").cast("string"), F.lit(1.0)),
        edge(p.where("goals_p90 > 0"), "POSTED_METRIC", whole, F.lit("goals_p90"), rounded(F.col("goals_p90"), 3)), fixed("REQUIRES", _REQUIRED), fixed("VALUES", _VALUED),
        edge(seasons.where("kinds > 1"), "SUPERSEDES", player, F.concat_ws(">", "last", "first"), F.lit(1.0)),
        edge(p, "FITS_STYLE", whole, F.lit("High Press"), rounded((F.col("defensive_activity") * 0.6 + F.col("press_resistance") * 0.4) / 100.0, 4)),
    ]
    return G.union_all(parts)


# Raw files: matches as nested JSON, written from orders, and read back

def _raw_folder(spark: SparkSession, d: str) -> str:
    """JSON arrays of matches in folders of depth two; every fiftieth lacks a key, and two files aren't arrays."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    n = F.col("o_orderkey")
    away = F.when(n % 50 != 7, F.struct(F.col("c_nationkey").cast("long").alias("away_team_id"), F.col("n_name").alias("away_team_name")))
    raw = o.select(
        n.alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"), (n % 40).alias("match_week"), (n % 2).alias("half"),
        F.struct((n % 5).alias("competition_id"), F.col("c_mktsegment").alias("competition_name")).alias("competition"), F.struct(F.year("o_orderdate").cast("long").alias("season_id"), F.year("o_orderdate").cast("string").alias("season_name")).alias("season"),
        F.struct(F.col("o_custkey").alias("home_team_id"), F.col("c_name").alias("home_team_name")).alias("home_team"), away.alias("away_team"), (n % 6).alias("home_score"), (n % 4).alias("away_score"),
        F.struct(F.lit(1).alias("id"), F.concat(F.lit("Ground "), (n % 9).cast("string")).alias("name")).alias("stadium"), F.when(n % 3 == 0, F.lit("available")).alias("match_status"),
    )
    folder = new_folder(spark)
    for half in (0, 1):
        write_json_arrays(raw.where(F.col("half") == half).drop("half"), f"{folder}/matches/{half}")
    spark.createDataFrame([("{\"match_id\": 1}",), ("[{\"match_id\": 2, ",)], "value string").coalesce(1).write.option("maxRecordsPerFile", 1).text(f"{folder}/matches/broken")
    return f"{folder}/matches"


@register("""SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, o_orderkey % 40 AS match_week, o_orderkey % 5 AS competition_id, c_mktsegment AS competition_name, year(o_orderdate) AS season_id, o_custkey AS home_team_id, c_name AS home_team_name,
  CASE WHEN o_orderkey % 50 <> 7 THEN c_nationkey END AS away_team_id, CASE WHEN o_orderkey % 50 <> 7 THEN n_name END AS away_team_name, o_orderkey % 6 AS home_score, o_orderkey % 4 AS away_score, 'Ground ' || CAST(o_orderkey % 9 AS VARCHAR) AS stadium_name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'available' END AS match_status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def raw_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches as nested JSON in folders, read back by the explicit schema and flattened; files that aren't arrays give
    no match (A1, A2, B1, B2, B4, B7, B9)."""
    path = _raw_folder(spark, d)
    flat = normalize.matches(read_json_arrays(spark, path, DT.StructType.fromDDL(normalize.MATCH)).where("competition IS NOT NULL"))
    return flat.select("match_id", "match_date", "match_week", "competition_id", "competition_name", "season_id", "home_team_id", "home_team_name", "away_team_id", "away_team_name", "home_score", "away_score", "stadium_name", "match_status")


@register("""SELECT 'bad_files' AS rule, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'records', count(*) FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'missing:away_team', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 50 = 7 HAVING count(*) > 0""")
def raw_report(spark: SparkSession, d: str) -> DataFrame:
    """Files whose root is no array, records, and required keys that records lack, from the raw files."""
    records = stored(raw_records(spark, _raw_folder(spark, d)))
    bad = records.where("record IS NULL").agg(F.count("*").alias("n")).select(F.lit("bad_files").alias("rule"), "n")
    faults = Q.key_faults(records, "match")
    missing = faults.select(F.explode("missing").alias("key")).groupBy(F.concat(F.lit("missing:"), "key").alias("rule")).agg(F.count("*").alias("n"))
    return bad.unionByName(faults.agg(F.count("*").alias("n")).select(F.lit("records").alias("rule"), "n")).unionByName(missing)
