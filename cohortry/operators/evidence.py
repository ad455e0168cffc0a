"""Evidence packets: a subject with its claims nested, and checks that a packet is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packets(claims: DataFrame, key: str, titles: DataFrame, title: str, k: int = 20) -> DataFrame:
    """One row a subject: key, title, metrics (an array of structs, the strongest first) and mean confidence.

    claims: key, capability, score, confidence (0 to 1). A subject has a bounded number of claims.
    """
    metric = F.struct((-F.col("score")).alias("o"), F.col("capability").alias("metric_name"), F.col("score").alias("value"), F.col("confidence"))
    g = claims.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(metric)), 1, k).alias("m"), F.avg("confidence").alias("confidence"))
    metrics = F.transform("m", lambda x: F.struct(x["metric_name"].alias("metric_name"), x["value"].alias("value"), x["confidence"].alias("confidence")))
    return g.join(titles.select(key, F.col(title).alias("title")), key, "left").select(key, "title", metrics.alias("metrics"), "confidence")


def packet_faults(required: list[str], least_members: Column | None = None) -> Column:
    """Names of what is wrong with a packet: no title, a confidence out of range, a required metric missing,
    too few members."""
    has = lambda name: F.exists("metrics", lambda m: m["metric_name"] == name)
    faults = [
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title"), F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence"),
        *[F.when(~F.coalesce(has(r), F.lit(False)), f"metric:{r}") for r in required],
    ]
    if least_members is not None:
        faults.append(F.when(~F.coalesce(least_members, F.lit(False)), "members"))
    return F.array_compact(F.array(*faults))


def related(signals: str, words: list[str]) -> Column:
    """Those of a row's signals that contain one of the words."""
    return F.filter(F.col(signals), lambda s: sum((F.when(F.contains(s, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) > 0)


def prefer(columns: list[str]) -> Column:
    """The name of the largest of several score columns, the first of the largest."""
    best = F.greatest(*columns)
    out = None
    for c in columns:
        out = F.when(F.col(c) == best, c) if out is None else out.when(F.col(c) == best, c)
    return out


#: The steps of a retrieval strategy and the claim types it expects.
PLANS = {
    "player": (["GET_ENTITY", "TRAVERSE_EDGES", "PROJECT_CLAIMS"], ["capability", "archetype"]),
    "comparison": (["GET_ENTITY", "TRAVERSE_EDGES", "PROJECT_CLAIMS"], ["capability", "archetype"]),
    "replacement": (["GET_ENTITY", "TRAVERSE_EDGES", "PROJECT_CLAIMS"], ["capability", "archetype", "role_fit"]),
    "team": (["GET_ENTITY", "TRAVERSE_EDGES", "PROJECT_CLAIMS"], ["team_capability", "team_fragility", "team_identity", "team_bottleneck", "team_concentration"]),
    "general": ([], []),
}


def plans(strategy: Column) -> Column:
    """The plan of a strategy as data (P13): a struct of steps and expected claim types."""
    out = None
    for name, (steps, types) in PLANS.items():
        lists = F.struct(F.array(*map(F.lit, steps)).cast("array<string>").alias("steps"), F.array(*map(F.lit, types)).cast("array<string>").alias("expected"))
        out = F.when(strategy == name, lists) if out is None else out.when(strategy == name, lists)
    return out


def strategy_scores(intent: Column, text: Column) -> dict[str, Column]:
    """The score of each strategy for an intent, else by a keyword."""
    low = F.lower(text)
    has = lambda *xs: F.exists(F.array(*[F.contains(low, F.lit(x)) for x in xs]), lambda x: x)
    return {
        "comparison": F.when(intent == "COMPARE_PLAYERS", 1.0).otherwise(0.0), "player": F.when(intent == "PLAYER_ANALYSIS", 1.0).when(has("player"), 0.6).otherwise(0.0),
        "team": F.when(intent == "TEAM_ANALYSIS", 1.0).when(has("team"), 0.4).otherwise(0.0), "replacement": F.when(intent == "RECRUITMENT", 0.8).when(has("replace"), 0.9).otherwise(0.0), "general": F.lit(0.5),
    }
