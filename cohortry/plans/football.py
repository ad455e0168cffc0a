"""Football profiles from the marts: vectors, roll-ups, capabilities, archetypes, ratings, teams, graph, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import bands, entity_key, position_group, rounded, title, weighted
from cohortry.operators import claims as C
from cohortry.operators import cohort as K
from cohortry.operators import graph as G
from cohortry.operators import scoring as S
from cohortry.operators import teams as T
from cohortry.sources.tables import forget, written

# Capabilities and the weights of their metrics' percentiles.
WEIGHTS = {
    "ball_progression": {"progressive_passes_p90": 0.40, "progressive_carries_p90": 0.35, "carry_distance_p90": 0.15, "switches_p90": 0.10},
    "chance_creation": {"shot_assists_p90": 0.45, "goal_assists_p90": 0.25, "through_balls_p90": 0.20, "crosses_p90": 0.10},
    "ball_security": {"pass_accuracy_pct": 0.35, "dribble_success_pct": 0.15, "passes_p90": 0.40, "avg_pass_length_m": 0.10},
    "press_resistance": {"pressure_pct": 0.50, "events_under_pressure_p90": 0.50},
    "attacking_threat": {"npxg_p90": 0.35, "goals_p90": 0.25, "xg_per_shot": 0.20, "shot_accuracy_pct": 0.15, "goals_minus_xg": 0.05},
}
DEFENDER_SECURITY = {"pass_accuracy_pct": 0.40, "dribble_success_pct": 0.05, "passes_p90": 0.45, "avg_pass_length_m": 0.10}
ACTIVE = {"pressures_p90": 0.25, "recoveries_p90": 0.25, "tackles_p90": 0.25, "interceptions_p90": 0.25}
CONTROLLING = {"clearances_p90": 0.20, "tackles_won_p90": 0.20, "aerials_won_p90": 0.30, "dribbled_past_p90": 0.15, "errors_leading_to_shot_p90": 0.15}
NEGATIVE = {"dribbled_past_p90", "errors_leading_to_shot_p90"}
CAPABILITIES = ["ball_progression", "chance_creation", "ball_security", "press_resistance", "defensive_activity", "attacking_threat"]
SHRINK_FROM, SHRINK_TO = 90.0, 900.0

# Archetypes as (position group, name, the six scores in the order of CAPABILITIES).
ARCHETYPES = [
    ("Center Forward", "Elite Goal Scorer", 40, 50, 50, 50, 30, 100), ("Center Forward", "Complete Forward", 75, 80, 80, 80, 60, 90), ("Center Forward", "Target Man", 40, 60, 60, 90, 40, 80),
    ("Winger", "Creative Winger", 85, 90, 75, 70, 40, 75), ("Winger", "Direct Winger", 90, 60, 70, 65, 45, 85), ("Attacking Midfielder", "Creative Playmaker", 90, 100, 85, 80, 40, 70),
    ("Central Midfielder", "Deep-Lying Playmaker", 100, 70, 100, 80, 60, 30), ("Central Midfielder", "Box-to-Box Engine", 80, 60, 75, 75, 80, 60),
    ("Defensive Midfielder", "Press-Resistant Anchor", 70, 40, 90, 100, 85, 20), ("Defensive Midfielder", "Midfield Destroyer", 50, 30, 70, 70, 95, 10),
    ("Fullback", "Progressive Fullback", 90, 80, 75, 70, 70, 50), ("Fullback", "Defensive Fullback", 60, 40, 75, 70, 85, 20),
    ("Center Back", "Ball-Playing Defender", 90, 50, 90, 80, 85, 20), ("Center Back", "Traditional Defender", 50, 20, 70, 60, 100, 10),
]
# Role families, their archetypes, and the importance of the six scores.
ROLES = {
    "Creative Attacker": (["Creative Forward", "Creative Playmaker", "Creative Winger"], (2.0, 3.0, 1.0, 1.0, 0.5, 2.0)),
    "Goal Scorer": (["Elite Goal Scorer", "Target Man", "Complete Forward", "Direct Winger"], (1.0, 1.5, 1.0, 1.5, 0.5, 3.5)),
    "Midfield Controller": (["Deep-Lying Playmaker", "Box-to-Box Engine"], (3.0, 1.5, 3.0, 2.5, 1.5, 0.5)),
    "Midfield Destroyer": (["Press-Resistant Anchor", "Midfield Destroyer"], (1.0, 0.5, 2.0, 2.0, 3.5, 0.2)),
    "Progressive Defender": (["Ball-Playing Defender", "Progressive Fullback"], (2.5, 1.0, 2.0, 1.5, 2.5, 0.5)),
    "Traditional Defender": (["Traditional Defender", "Defensive Fullback"], (1.0, 0.2, 1.5, 1.5, 4.0, 0.2)),
    "Goalkeeper": ([], (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)),
    "Balanced": (["Unknown", "General"], (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)),
}
# Z-profiles of styles of play, in the order of CAPABILITIES.
STYLES = {
    "Possession-Dominant": (0.5, 0.5, 1.5, 1.0, -1.0, 0.0), "High Press": (0.0, 0.0, -0.5, 0.5, 1.5, 0.0), "Direct and Progressive": (1.5, 1.0, -1.0, 0.0, 0.0, 1.0),
    "Counter-Attacking": (1.0, 0.5, -1.5, -0.5, 0.5, 1.5), "Defensive and Resilient": (-1.0, -1.0, 0.5, 0.0, 1.5, -1.0),
}
BOTTLENECKS = [("ball_progression", "attacking_threat"), ("chance_creation", "attacking_threat"), ("defensive_activity", "ball_security")]

METRICS = sorted({m for w in WEIGHTS.values() for m in w} | set(ACTIVE) | set(CONTROLLING) | {"aerials_total_p90"})
#: Counts that vectors carry beside their rates.
COUNTS = [
    "goals", "goal_assists", "shot_assists", "total_shots", "shots_on_target", "total_passes", "accurate_passes", "progressive_passes", "progressive_carries", "total_carries",
    "total_dribbles", "dribbles_completed", "pressures", "ball_recoveries", "clearances", "tackles", "interceptions", "aerials_won", "aerials_total",
]


def vectors(summary: DataFrame) -> DataFrame:
    """Competition vectors from the player mart: null metrics become 0."""
    df = summary.select(
        "player_id", "player_name", "team_name", F.col("competition_name").alias("competition"), F.col("season_name").alias("season"), "birth_date",
        position_group(F.col("position_name")).alias("position_group"), F.lit("competition").alias("profile_type"), "minutes_played", "matches_played",
        "positions_played_count", *METRICS, *COUNTS,
    )
    return df.fillna(0, [*METRICS, *COUNTS]).fillna(1, ["positions_played_count"])


def _modal(values: Column) -> Column:
    """Most frequent element of a collected list, the smallest in a tie; lists hold one element a vector of a player."""
    kinds = F.array_sort(F.array_distinct(values))
    counted = F.transform(kinds, lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("v")))
    return F.array_min(counted)["v"]


def rolled_up(df: DataFrame, level: str) -> DataFrame:
    """Competition vectors to season vectors (level "season"), or season vectors to career vectors ("career").

    Rates become counts, counts are summed and normalised anew. Which quantity has a count of its own and
    which is rebuilt from its rate differs by level: see the lists below (F15, F16).
    """
    keys = ["player_id", "season"] if level == "season" else ["player_id"]
    m = F.col("minutes_played").cast("double")
    back = lambda c: F.col(c) / 90.0 * m
    own = {"progressive_passes_p90": "progressive_passes", "progressive_carries_p90": "progressive_carries", "shot_assists_p90": "shot_assists", "goal_assists_p90": "goal_assists", "goals_p90": "goals", "passes_p90": "total_passes", "aerials_won_p90": "aerials_won", "aerials_total_p90": "aerials_total"}
    if level == "season":
        own |= {"pressures_p90": "pressures", "clearances_p90": "clearances"}
    rates = [c for c in METRICS if c.endswith("_p90")]
    counts = {c: F.col(own[c]).cast("double") if c in own else back(c) for c in rates}
    xg = F.col("goals") - F.col("goals_minus_xg")
    pressed = back("events_under_pressure_p90")
    parts = counts | {
        "__accurate": F.col("accurate_passes").cast("double"), "__length": F.col("avg_pass_length_m") * F.col("total_passes"), "__dribbles": F.col("total_dribbles").cast("double"),
        "__dribbled": F.col("dribble_success_pct") / 100.0 * F.col("total_dribbles"), "__events": F.when(F.col("pressure_pct") > 0, pressed / (F.col("pressure_pct") / 100.0)).otherwise(0.0),
        "__xg": xg, "__shots": F.when(F.col("xg_per_shot") > 0, xg / F.col("xg_per_shot")).otherwise(0.0), "__on_target": F.col("shots_on_target").cast("double"),
    }
    known = F.array_compact(F.collect_list(F.when(F.col("position_group") != "Unknown", F.col("position_group"))))
    squads = F.array_compact(F.collect_list(F.when(F.col("team_name") != "", F.col("team_name"))))
    first = F.first("birth_date", ignorenulls=True)
    g = df.groupBy(*keys).agg(
        F.min("player_name").alias("player_name"), squads.alias("__teams"), known.alias("__positions"), first.alias("birth_date"), F.sum("minutes_played").alias("minutes_played"),
        F.sum("matches_played").alias("matches_played"), F.max("positions_played_count").alias("positions_played_count"),
        *[F.sum(v).alias(f"__s_{k}") for k, v in parts.items()], *[F.sum(c).alias(c) for c in COUNTS],
    )
    total = F.nullif(F.col("minutes_played").cast("double"), F.lit(0.0))
    s = lambda c: F.col(f"__s_{c}")
    over = lambda a, b, digits, scale=1.0: F.coalesce(rounded(a * scale / F.nullif(b, F.lit(0.0)), digits), F.lit(0.0))
    out = {c: F.coalesce(rounded(s(c) * 90.0 / total, 3), F.lit(0.0)) for c in rates}
    out |= {
        "pass_accuracy_pct": over(s("__accurate"), s("passes_p90"), 1, 100.0), "dribble_success_pct": over(s("__dribbled"), s("__dribbles"), 1, 100.0),
        "avg_pass_length_m": over(s("__length"), s("passes_p90"), 1), "pressure_pct": over(s("events_under_pressure_p90"), s("__events"), 1, 100.0),
        "xg_per_shot": over(s("__xg"), s("__shots"), 3), "shot_accuracy_pct": over(s("__on_target"), s("__shots"), 1, 100.0), "goals_minus_xg": rounded(s("goals_p90") - s("__xg"), 3),
        "team_name": F.when(F.size("__teams") == 0, "Unknown").when(F.size(F.array_distinct("__teams")) > 1, "Multiple").otherwise(F.get("__teams", F.lit(0))),
        "position_group": F.coalesce(_modal(F.col("__positions")), F.lit("Unknown")), "competition": F.lit("All Competitions"), "profile_type": F.lit(level),
    }
    if level == "career":
        out["season"] = F.lit("Career")
    g = g.withColumns(out)
    return g.select(*[c for c in df.columns if c in g.columns])


def all_levels(summary: DataFrame) -> DataFrame:
    competition = vectors(summary)
    season = rolled_up(competition, "season")
    return G.union_all([competition, season, rolled_up(season, "career")])


def profiles(spark: SparkSession, vectors: DataFrame, competition_matches: int = 38, strict: bool = True) -> DataFrame:
    """A profile for each vector: shrunk metrics, percentiles, capabilities, attributes, archetype, role, rating, signals.

    With strict the weights of ball security for defenders apply to the group of that name only, which no
    position maps to; without, to center backs and fullbacks (K1, K2, L1-L10, K8).
    """
    cohort, ids = ["profile_type", "position_group"], ["player_id", "profile_type", "position_group", "competition", "season", "team_name"]
    v = written(vectors.withColumn("key", F.xxhash64(*ids)))
    shrunk = K.shrunk(v, METRICS, "minutes_played", cohort, SHRINK_FROM, SHRINK_TO).select("key", *cohort, *METRICS)
    p = K.midrank_percentiles(shrunk, cohort, METRICS, ["key"], suffix="").drop(*cohort)
    groups = {"Defender": DEFENDER_SECURITY} | ({} if strict else {"Center Back": DEFENDER_SECURITY, "Fullback": DEFENDER_SECURITY})
    pg = p.join(v.select("key", "position_group"), "key")
    scores = {c: rounded(weighted(w), 6) for c, w in WEIGHTS.items()}
    scores["ball_security"] = rounded(S.by_group("position_group", groups, WEIGHTS["ball_security"]), 6)
    scores["defensive_activity"] = S.best_of(ACTIVE, CONTROLLING, NEGATIVE)
    caps = pg.select("key", *[scores[c].alias(c) for c in CAPABILITIES], *[F.col(m).alias(f"pct_{m}") for m in METRICS])
    df = whole = written(v.join(caps, "key"))  # read by several steps below
    forget(v)

    low = F.col("matches_played") < 8
    versatile = df.withColumns({"threat": F.col("attacking_threat"), "defence": F.col("defensive_activity")})
    df = versatile.withColumns({
        "tactical_versatility": rounded(S.versatility(F.col("positions_played_count"), CAPABILITIES, low), 4),
        "availability_rating": rounded(S.availability(F.col("matches_played") / float(competition_matches), F.lit(50.0)), 4),
        "minutes_reliability": bands(F.col("matches_played"), [(25, "High"), (15, "Medium")], "Low"), "confidence": K.confidence(F.col("matches_played")),
        "sufficient_sample": F.col("minutes_played") >= 450,
    }).drop("threat", "defence")

    templates = spark.createDataFrame([(g, n, *map(float, s)) for g, n, *s in ARCHETYPES], ["group", "template", *[f"t_{c}" for c in CAPABILITIES]])
    standing = K.midrank_percentiles(df, cohort, CAPABILITIES, ["key"], suffix="").drop("profile_type")
    best = S.best_templates(standing, "key", CAPABILITIES, templates, "position_group").where("rank = 1").select("key", "template", "similarity")
    df = df.join(best, "key", "left")
    nothing = F.greatest(*CAPABILITIES) == 0
    name = F.when(F.col("position_group") == "Goalkeeper", "Goalkeeper").when(nothing, "Unknown").otherwise(F.coalesce("template", F.lit("Unknown")))
    df = df.withColumn("archetype", name).withColumn("archetype_confidence", F.when(F.col("archetype") == "Unknown", 0.0).otherwise(F.coalesce("similarity", F.lit(1.0)))).drop("template", "similarity")
    family = None
    for role, (names, _) in ROLES.items():
        hit = F.col("archetype").isin(names)
        if names:
            family = F.when(hit, role) if family is None else family.when(hit, role)
    df = df.withColumn("role_family", family.otherwise("Balanced")).withColumn("role_label", role_label())
    df = df.withColumn("overall_rating", S.role_rating(CAPABILITIES, {r: dict(zip(CAPABILITIES, w, strict=True)) for r, (_, w) in ROLES.items()}, "role_family"))
    df = S.presented_rating(df, "overall_rating", ["role_family"])
    out = written(df.withColumn("decision_signals", S.signals(signal_rules())))
    forget(whole)
    return out


def role_label() -> Column:
    """The first rule that holds (L5). Thresholds and labels."""
    c = F.col
    many = sum((F.when(c(x) >= 60, 1).otherwise(0) for x in CAPABILITIES), F.lit(0))
    return (
        F.when(c("attacking_threat") >= 85, "Elite Goal Scorer")
        .when((c("chance_creation") >= 80) & (c("ball_progression") >= 65), "Creative Playmaker")
        .when((c("ball_security") >= 80) & (c("ball_progression") >= 75), "Deep-Lying Playmaker")
        .when((c("ball_progression") >= 70) & (c("defensive_activity") >= 70), "Box-to-Box Midfielder")
        .when((c("ball_progression") >= 75) & (c("chance_creation") >= 65) & (c("position_group") == "Fullback"), "Progressive Fullback")
        .when((c("defensive_activity") >= 85) & (c("ball_security") >= 70), "Defensive Specialist")
        .when((c("press_resistance") >= 85) & (c("ball_security") >= 75), "Press-Resistant Anchor")
        .when((c("defensive_activity") >= 80) & (c("tactical_versatility") >= 65), "High-Energy Presser")
        .when(c("tactical_versatility") >= 85, "Versatile Asset")
        .when((F.least(*CAPABILITIES) >= 40) & (many >= 4), "All-Round Contributor")
        .otherwise("Developing Profile")
    )


def signal_rules() -> list[tuple[str, Column]]:
    """Rules of the decision signals (L11). Thresholds and names."""
    c = F.col
    return [
        ("elite_goal_scorer", c("attacking_threat") >= 85), ("strong_chance_creator", c("chance_creation") >= 80),
        ("clinical_finisher", (c("goals_minus_xg") > 0) & (c("goals_p90") * c("minutes_played") / 90 >= 3)), ("xg_efficient_attacker", c("xg_per_shot") > 0.10),
        ("dual_threat_forward", (c("attacking_threat") >= 70) & (c("chance_creation") >= 70)), ("elite_ball_progressor", c("ball_progression") >= 85),
        ("progressive_fullback", (c("ball_progression") >= 75) & (c("chance_creation") >= 60) & (c("position_group") == "Fullback")),
        ("line_breaking_passer", c("pct_progressive_passes_p90") >= 80), ("ball_carrying_threat", c("pct_progressive_carries_p90") >= 80),
        ("high_press_resistant", c("press_resistance") >= 80), ("technical_ball_retainer", c("ball_security") >= 80),
        ("reliable_passer", (c("pass_accuracy_pct") > 85) & (c("pct_passes_p90") > 50)), ("defensive_specialist", c("defensive_activity") >= 85),
        ("high_intensity_presser", c("pct_pressures_p90") >= 80), ("ball_winner", c("pct_recoveries_p90") >= 75), ("tactically_versatile", c("tactical_versatility") >= 80),
        ("box_to_box_profile", (c("ball_progression") >= 70) & (c("defensive_activity") >= 70)), ("well_rounded", F.least(*CAPABILITIES) >= 60),
        ("low_availability_risk", c("availability_rating") >= 80), ("small_sample_warning", c("matches_played") < 5),
    ]


TEAM = ["team_name", "competition", "season"]


def team_profiles(df: DataFrame) -> dict[str, DataFrame]:
    """Means with grade, concentration, bottlenecks, fragility and identity of the teams of competition profiles."""
    squad = df.where((F.col("profile_type") == "competition") & (F.col("team_name") != "Multiple"))
    means = squad.groupBy(*TEAM).agg(F.count("*").alias("squad_size"), *[rounded(F.avg(c), 1).alias(c) for c in CAPABILITIES])
    mean = sum((F.col(c) for c in CAPABILITIES), F.lit(0.0)) / len(CAPABILITIES)
    tall = T.long_scores(squad, [*TEAM, "player_id"], CAPABILITIES)
    whole = squad.agg(*[F.avg(c).alias(f"a_{c}") for c in CAPABILITIES], *[F.stddev_pop(c).alias(f"d_{c}") for c in CAPABILITIES])
    exact = squad.groupBy(*TEAM).agg(*[F.avg(c).alias(c) for c in CAPABILITIES]).crossJoin(F.broadcast(whole))  # one row
    z = exact.select(*TEAM, *[((F.col(c) - F.col(f"a_{c}")) / F.when(F.col(f"d_{c}") == 0, 1.0).otherwise(F.col(f"d_{c}"))).alias(f"z_{c}") for c in CAPABILITIES])
    return {
        "means": means.withColumn("grade", S.grade(mean)).withColumn("team_id", F.xxhash64(*TEAM)), "concentration": T.concentration(tall, TEAM), "bottlenecks": T.bottlenecks(means, TEAM, BOTTLENECKS),
        "dependency": T.shares(tall, TEAM, "player_id"), "fragility": T.fragility(squad, "player_id", TEAM, "position_group", CAPABILITIES),
        "identity": T.best_styles(z, TEAM, CAPABILITIES, {n: dict(zip(CAPABILITIES, v, strict=True)) for n, v in STYLES.items()}),
    }


def knowledge_graph(df: DataFrame, teams: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of players, teams, capabilities, archetypes and signals."""
    career, local = df.where("profile_type = 'career'"), df.where("profile_type = 'competition' AND team_name <> 'Multiple'").withColumn("team", entity_key(*map(F.col, TEAM)))
    means, fragile = teams["means"].withColumn("team", entity_key(*map(F.col, TEAM))), teams["fragility"].withColumn("team", entity_key(*map(F.col, TEAM)))
    tall = T.long_scores(career, ["player_id"], CAPABILITIES)
    squad = T.long_scores(means, ["team"], CAPABILITIES)
    triggered = career.select("player_id", F.explode("decision_signals").alias("signal")).distinct()
    nodes = G.union_all([G.nodes(career, "player", "player_id", "player_name"), G.nodes(means, "team", "team", "team_name")])
    edges = G.union_all([
        G.edges(tall, "HAS_CAPABILITY", ("player", "player_id"), ("capability", "capability"), F.col("score") / 100.0),
        G.edges(local, "MEMBER_OF", ("player", "player_id"), ("team", "team"), None),
        G.edges(career.where("archetype <> 'Unknown' OR archetype_confidence > 0"), "CLASSIFIED_AS", ("player", "player_id"), ("archetype", "archetype"), F.col("archetype_confidence")),
        G.edges(triggered, "TRIGGERS", ("player", "player_id"), ("signal", "signal"), None),
        G.edges(squad, "HAS_SQUAD_CAPABILITY", ("team", "team"), ("capability", "capability"), F.col("score") / 100.0),
        G.edges(fragile, "FRAGILE_ON", ("team", "team"), ("player", "player_id"), F.least(F.lit(1.0), F.col("deficit") / 100.0)),
        G.edges(teams["bottlenecks"].withColumn("team", entity_key(*map(F.col, TEAM))), "HAS_BOTTLENECK", ("team", "team"), ("capability", "downstream"), F.col("severity") / 100.0),
        G.edges(teams["concentration"].withColumn("team", entity_key(*map(F.col, TEAM))), "HAS_CONCENTRATION", ("team", "team"), ("capability", "capability"), F.col("hhi") / 10000.0),
    ])
    return nodes, edges


def player_claims(df: DataFrame, fingerprint: str) -> DataFrame:
    """Capability and archetype claims of careers, with qualifiers."""
    career = df.where("profile_type = 'career'").withColumn("n", F.col("matches_played"))
    rules = [*C.sample_rules("matches_played", "minutes_played"), ("overperformance", "informational", F.col("goals_minus_xg") > 2)]
    caveats = career.select("player_id", C.qualifiers(rules).alias("qualifiers"))
    scores = C.capability_claims(T.long_scores(career, ["player_id", "n"], CAPABILITIES), "player_id", fingerprint).withColumn("statement", F.concat_ws(" ", "level", title(F.col("capability"))))
    from cohortry.functions.scalar import short_id

    kind = career.where("archetype <> 'Unknown'").select(
        short_id(F.col("player_id").cast("string"), F.lit("archetype"), F.lit(fingerprint)).alias("claim_id"), "player_id", F.lit("archetype").alias("claim_type"), F.lit(None).cast("string").alias("capability"),
        (F.col("archetype_confidence") * 100).alias("score"), F.col("archetype").alias("level"), F.when(F.col("archetype_confidence") >= 0.8, "high").otherwise("medium").alias("confidence"), F.col("archetype").alias("statement"),
    )
    return scores.unionByName(kind).join(caveats, "player_id")


def team_claims(teams: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """Identity, bottleneck, concentration and the k largest fragility claims of teams: team, type, subject, strength."""
    pick = lambda df, kind, subject, strength: df.select(*TEAM, F.lit(kind).alias("claim_type"), subject.alias("subject"), strength.cast("double").alias("strength"))
    worst = K.top_k(teams["fragility"], TEAM, [F.desc("deficit"), F.col("player_id")], k)
    identity = F.when(F.col("secondary_style").isNotNull(), 75.0).when(F.col("primary_style") != "Balanced", 60.0).otherwise(40.0)
    return G.union_all([
        pick(teams["identity"], "identity", F.col("primary_style"), identity), pick(worst, "fragility", F.col("player_id").cast("string"), F.col("deficit")),
        pick(teams["bottlenecks"], "bottleneck", F.concat_ws(">", "upstream", "downstream"), F.lit(100.0) - F.least(F.col("severity"), F.lit(100.0))),
        pick(teams["concentration"].where("over_centralised"), "concentration", F.col("capability"), F.greatest(F.lit(0.0), F.lit(100.0) - F.col("hhi") / 50.0)),
    ])


def timeline(df: DataFrame, player_id: int) -> DataFrame:
    """All profiles of a player, latest season first, the season's profile before those of its competitions."""
    return df.where(F.col("player_id") == player_id).orderBy(F.desc("season"), F.when(F.col("profile_type") == "season", 0).otherwise(1))


def team_depth(df: DataFrame) -> DataFrame:
    """Members by team and position, with the rank of each by rating."""
    w = Window.partitionBy(*TEAM, "position_group").orderBy(F.desc("overall_rating"), "player_id")
    return df.where("profile_type = 'competition'").select(*TEAM, "position_group", "player_id", "overall_rating", F.row_number().over(w).cast("long").alias("depth"))


def statistic_category() -> Column:
    """Which group of statistics suits a player, by role family, else by position."""
    role, low = F.col("role_family"), F.lower("position_group")
    part = lambda x: F.contains(low, F.lit(x))
    return (
        F.when(role == "Goalkeeper", "Goalkeeper").when(role.isin("Progressive Defender", "Traditional Defender"), "Defender")
        .when(role.isin("Midfield Controller", "Midfield Destroyer"), "Midfielder").when(role.isin("Creative Attacker", "Goal Scorer"), "Attacker")
        .when(part("goalkeeper"), "Goalkeeper").when(part("back") | part("defender"), "Defender").when(part("mid"), "Midfielder").otherwise("Attacker")
    )


def capability_struct() -> Column:
    """The six scores, their confidence and their weakest, as one nested column."""
    return F.struct(*CAPABILITIES, "confidence", F.least(*CAPABILITIES).alias("weakest"))
