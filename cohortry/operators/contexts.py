"""Explanation contexts of four kinds, nested structs assembled from parts, and what each of them lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import title
from cohortry.operators.cohort import top_k

#: The score from which a packet takes all signals if none is its own, the fragilities kept, the shared
#: strengths' least score and the least gap of a key difference.
STRONG, FRAGILITIES, SHARED, GAP = 80.0, 3, 70.0, 15.0


def packet(capability: str, score: Column, confidence: Column, signals: Column, suffix: str = "Capability", explained: str = "Overall Score") -> Column:
    """The evidence of a capability: source, title, confidence, metrics, signals, caveats. Its signals are those that its
    name contains; a strong score without any takes all."""
    own = F.filter(signals, lambda s: F.contains(F.lit(capability), F.lower(s)))
    none = F.array().cast("array<string>")
    metric = F.struct(F.lit("score").alias("metric_name"), score.alias("raw_value"), score.alias("percentile"), F.lit(1.0).alias("weight"), F.lit(explained).alias("explanation"))
    return F.struct(
        F.lit(f"capability:{capability}").alias("source"), F.concat(title(F.lit(capability)), F.lit(f" {suffix}")).alias("title"), confidence.alias("confidence"), F.array(metric).alias("metrics"),
        F.when(F.size(own) > 0, own).when(score > STRONG, signals).otherwise(none).alias("signals"), none.alias("caveats"),
    )


def packets(capabilities: list[str], confidence: Column, signals: Column, **how) -> Column:
    """A packet for each capability whose score is known."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), packet(c, F.col(c), confidence, signals, **how)) for c in capabilities]))


def player_contexts(players: DataFrame, capabilities: list[str], confidence: Column, signals: Column, keep: list[str]) -> DataFrame:
    """The columns `keep` of players (key and name among them), overall_confidence and packets."""
    return players.select(*keep, confidence.alias("overall_confidence"), packets(capabilities, confidence, signals).alias("packets"))


def team_contexts(
    means: DataFrame, team: str, capabilities: list[str], styles: DataFrame, concentration: DataFrame, bottlenecks: DataFrame, fragility: DataFrame, member: str, name: str
) -> DataFrame:
    """means(team, squad_size, capabilities) with style, the risks of concentration that are over the limit, bottlenecks
    (the most severe first), the members whose loss costs most, and a packet for each capability.

    Each part is grouped by team first; a team has a bounded number of capabilities and rules, and its fragile
    members are cut to FRAGILITIES before they are gathered. A team that lacks a part gets an empty one.
    """
    listed = lambda df, columns, out, order: df.groupBy(team).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("x")))).alias("l")).select(team, F.col("l.x").alias(out))
    risks = listed(concentration.where("over_centralised"), ["capability", "hhi"], "risks", ["capability"])
    narrow = listed(bottlenecks.withColumn("o", -F.col("severity")), ["upstream", "downstream", "severity"], "bottlenecks", ["o", "upstream", "downstream"])
    worst = top_k(fragility, [team], [F.desc("deficit"), F.col(member)], FRAGILITIES, "place")
    fragile = listed(worst, [member, name, "loss", "deficit"], "fragilities", ["place"])
    out = means.join(styles, team, "left")
    for part in (risks, narrow, fragile):
        out = out.join(part, team, "left")
    none = F.array().cast("array<string>")
    own = packets(capabilities, F.lit(1.0), none, suffix="Capability (Squad Avg)", explained="Average squad capability")
    empty = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType)).alias(c)
    return out.select(team, "squad_size", F.col("primary_style").alias("style"), empty("risks", risks), empty("bottlenecks", narrow), empty("fragilities", fragile), own.alias("packets"))


def comparison_contexts(pairs: DataFrame, key: str, other: str, contexts: DataFrame, scores: DataFrame, capabilities: list[str]) -> DataFrame:
    """pairs(key, other) with the contexts of both (an array of those known), the strengths they share and the
    capabilities in which they differ. contexts and scores have the key; a pair may lack its second member."""
    whole = contexts.select(F.col(key).alias("__k"), F.struct(*contexts.columns).alias("context")).join(scores.select(F.col(key).alias("__k"), F.struct(*capabilities).alias("scores")), "__k")
    side = lambda n: whole.select(F.col("__k").alias(f"__{n}"), F.col("context").alias(f"context_{n}"), F.col("scores").alias(f"scores_{n}"))
    j = pairs.join(side("a"), F.col(key) == F.col("__a"), "left").join(side("b"), F.col(other) == F.col("__b"), "left")
    of = lambda n, c: F.col(f"scores_{n}")[c]
    named = lambda test: F.array_compact(F.array(*[F.when(test(c), F.lit(c)) for c in capabilities]))
    return j.select(
        key, other, F.array_compact(F.array("context_a", "context_b")).alias("players"),
        named(lambda c: F.least(of("a", c), of("b", c)) >= SHARED).alias("shared_strengths"),
        named(lambda c: F.abs(of("a", c) - of("b", c)) > GAP).alias("key_differences"),
    )


def recruitment_contexts(positions: DataFrame, position: str, candidates: DataFrame, name: str, required: dict[str, float], style: str, k: int) -> DataFrame:
    """For each position the k best candidates(position, name, fit_score, capabilities) as an array of structs, ranked,
    with the required capabilities in which they are strong (80 and more) or weak (under 50): a top-k report
    by position. A position without candidates has an empty array."""
    best = top_k(candidates, [position], [F.desc("fit_score"), F.col(name)], k)
    named = lambda test: F.array_compact(F.array(*[F.when(test(F.col(c)), F.lit(c)) for c in required]))
    one = F.struct("rank", F.col(name).alias("player_name"), "fit_score", named(lambda x: x >= 80).alias("strengths"), named(lambda x: x < 50).alias("trade_offs"))
    found = best.groupBy(position).agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    out = positions.select(position).distinct().join(found, position, "left")
    return out.select(position, F.lit(style).alias("tactical_style"), F.array(*map(F.lit, required)).alias("required"), F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)).alias("candidates"))


def _bad_share(x: Column) -> Column:
    return ~F.coalesce(x.between(0.0, 1.0), F.lit(False))


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def packet_fault(p: Column) -> Column:
    """The first thing wrong with a packet, or null: title, confidence, metrics, or a capability's score missing."""
    scored = F.coalesce(F.exists(p["metrics"], lambda m: m["metric_name"] == "score"), F.lit(False))
    return F.when(_blank(p["title"]), "title").when(_bad_share(p["confidence"]), "confidence").when(p["metrics"].isNull(), "metrics").when(F.startswith(p["source"], F.lit("capability:")) & ~scored, "score")


def _of_packets(packed: Column) -> Column:
    return F.filter(F.transform(F.coalesce(packed, F.array().cast("array<struct<source:string,title:string,confidence:double,metrics:array<struct<metric_name:string,raw_value:double,percentile:double,weight:double,explanation:string>>,signals:array<string>,caveats:array<string>>>")), lambda p: F.concat(F.lit("packet:"), packet_fault(p))), lambda f: f.isNotNull())


def player_faults(name: Column, packed: Column, confidence: Column) -> Column:
    own = F.array_compact(F.array(F.when(_blank(name), "name"), F.when(F.coalesce(F.size(packed), F.lit(0)) < 1, "packets"), F.when(_bad_share(confidence), "confidence")))
    return F.concat(own, _of_packets(packed))


def team_faults(team: Column) -> Column:
    own = F.array_compact(F.array(F.when(_blank(team), "name"), F.when(~F.coalesce(F.col("squad_size") > 0, F.lit(False)), "squad_size"), F.when(_blank(F.col("style")), "style")))
    return F.concat(own, _of_packets(F.col("packets")))


def comparison_faults(name: str) -> Column:
    """Too few players, and the faults of each player's own context."""
    few = F.when(F.size("players") < 2, F.array(F.lit("players"))).otherwise(F.array().cast("array<string>"))
    return F.concat(few, F.flatten(F.transform("players", lambda p: player_faults(p[name], p["packets"], p["overall_confidence"]))))


def recruitment_faults(position: Column) -> Column:
    own = F.array_compact(F.array(F.when(_blank(position), "position"), F.when(F.size("candidates") < 1, "candidates")))
    each = F.transform("candidates", lambda c, i: F.when(c["fit_score"].isNull(), F.concat(F.lit("fit_score:"), i)).when(_blank(c["player_name"]), F.concat(F.lit("player_name:"), i)))
    return F.concat(own, F.array_compact(each))
