"""Weighted scores, templates, role ratings and rule labels over score columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import bands, clip, interpolated, normal_cdf, rounded, weighted
from cohortry.operators.cohort import vector_similarity, z_score

#: Percentile to displayed rating.
RATING_KNOTS = [(0.0, 40.0), (50.0, 70.0), (75.0, 78.0), (90.0, 84.0), (95.0, 88.0), (98.0, 92.0), (99.0, 94.0), (99.5, 96.0), (99.9, 99.0), (100.0, 99.9)]
#: Grades by mean capability.
GRADES = [(85, "A+"), (80, "A"), (75, "A-"), (70, "B+"), (65, "B"), (60, "B-"), (55, "C+"), (50, "C"), (45, "C-")]


def strength_band(score: Column) -> Column:
    """elite from 80, excellent from 70, limited up to 40, else null."""
    return F.when(score >= 80, "elite").when(score >= 70, "excellent").when(score <= 40, "limited")


def best_of(first: dict[str, float], second: dict[str, float], inverted: set[str] = frozenset(), digits: int = 6) -> Column:
    """The larger of two weighted sums; metrics in `inverted` count as 100 minus their value."""
    side = lambda w: sum(((F.lit(100.0) - F.col(m)) if m in inverted else F.col(m)) * F.lit(float(v)) for m, v in w.items())
    return rounded(F.greatest(side(first), side(second)), digits)


def by_group(group: str, weights: dict[str, dict[str, float]], default: dict[str, float]) -> Column:
    """A weighted sum whose weights depend on the group."""
    out = None
    for name, w in weights.items():
        out = F.when(F.col(group) == name, weighted(w)) if out is None else out.when(F.col(group) == name, weighted(w))
    return weighted(default) if out is None else out.otherwise(weighted(default))


def availability(coverage: Column, percentile: Column) -> Column:
    return F.least(F.lit(100.0), coverage * 60.0 + percentile * 0.4)


def versatility(positions: Column, scores: list[str], low_sample: Column, least_scores: int = 7) -> Column:
    """Positions played (0, 40, 70, 100), breadth from the scores' spread, balance of attack and defence.

    With fewer scores than least_scores breadth is 50.
    """
    positional = F.when(positions >= 4, 100.0).when(positions == 3, 70.0).when(positions == 2, 40.0).otherwise(0.0)
    mean = sum((F.col(s) for s in scores), F.lit(0.0)) / len(scores)
    spread = F.sqrt(sum(((F.col(s) - mean) * (F.col(s) - mean) for s in scores), F.lit(0.0)) / len(scores))
    breadth = F.greatest(F.lit(0.0), (F.lit(1.0) - spread / 50.0) * 100.0) if len(scores) >= least_scores else F.lit(50.0)
    attack, defence = F.col("threat"), F.col("defence")
    high = F.greatest(attack, defence)
    balance = F.when(high > 0, F.least(attack, defence) / high * 100.0).otherwise(0.0)
    full = positional * 0.25 + breadth * 0.4 + balance * 0.35
    return F.when(low_sample, positional * 0.1 + breadth * 0.55 + balance * 0.35).otherwise(full)


def role_rating(scores: list[str], vectors: dict[str, dict[str, float]], family: str) -> Column:
    """Weighted mean of the scores by the weights of the row's role family."""
    out = None
    for name, w in vectors.items():
        value = weighted({s: w[s] for s in scores}) / F.lit(float(sum(w[s] for s in scores)))
        out = F.when(F.col(family) == name, value) if out is None else out.when(F.col(family) == name, value)
    return rounded(out, 1)


def presented_rating(df: DataFrame, raw: str, cohort: list[str]) -> DataFrame:
    """df with z_score in the cohort, its normal percentile and the displayed rating.

    Each step is a projection of its own, so that a value used many times is computed once.
    """
    df = z_score(df, cohort, raw, "__z")
    df = df.withColumn("__p", normal_cdf(F.col("__z")) * 100)
    shown = rounded(clip(interpolated(F.col("__p"), RATING_KNOTS), 0.0, 99.9), 1)
    out = {"z_score": rounded(F.col("__z"), 2), "rating_percentile": rounded(F.col("__p"), 1), "display_rating": shown}
    return df.withColumns(out).drop("__z", "__p")


def best_templates(df: DataFrame, key: str, scores: list[str], templates: DataFrame, group: str | None = None, least: float = 0.3, keep: int = 3, max_distance: float = 245.0) -> DataFrame:
    """key, rank, template, similarity: the templates (columns template, group, t_<score>) most like the row.

    Similarity is .75 cosine and .25 Euclidean; below `least` the template is Unknown. Templates are a
    small table, joined on the group; rows of a group without templates meet all of them.
    """
    t = F.broadcast(templates)
    if group:
        groups = templates.select(F.col("group").alias("__g")).distinct()
        known = df.join(F.broadcast(groups), F.col(group) == F.col("__g"), "left")
        pairs = known.join(t, (F.col("__g") == F.col("group")) | F.col("__g").isNull())
    else:
        pairs = df.crossJoin(t)
    cosine, distance = vector_similarity([F.col(s) for s in scores], [F.col(f"t_{s}") for s in scores])
    similarity = cosine * 0.75 + F.greatest(F.lit(0.0), F.lit(1.0) - distance / max_distance) * 0.25
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), F.col("template"))
    ranked = pairs.withColumn("similarity", rounded(similarity, 6)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= keep)
    return ranked.select(key, "rank", F.when(F.col("similarity") < least, "Unknown").otherwise(F.col("template")).alias("template"), "similarity")


def signals(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def grade(mean: Column) -> Column:
    return F.when(mean.isNull() | (mean <= 0), "N/A").otherwise(bands(mean, GRADES, "D"))


def rolled_up(df: DataFrame, keys: list[str], rates: dict[str, str], exposure: str, shares: dict[str, tuple[str, str]], per: float = 90.0) -> DataFrame:
    """Rates and shares of several vectors as one: rates become counts again and are normalised anew,
    shares weigh by their whole. rates: rate -> digits source column; shares: share -> (part, whole)."""
    counts = [F.sum(F.col(r) * F.col(exposure) / per).alias(f"__{r}") for r in rates]
    sums = {c for pair in shares.values() for c in pair}
    g = df.groupBy(*keys).agg(F.sum(exposure).alias(exposure), F.count("*").alias("n_vectors"), *counts, *[F.sum(c).alias(c) for c in sorted(sums)])
    e = F.nullif(F.col(exposure).cast("double"), F.lit(0.0))
    out = {r: F.coalesce(rounded(F.col(f"__{r}") * per / e, 3), F.lit(0.0)) for r in rates}
    out |= {s: F.coalesce(rounded(F.col(a) * 100.0 / F.nullif(F.col(b).cast("double"), F.lit(0.0)), 1), F.lit(0.0)) for s, (a, b) in shares.items()}
    return g.withColumns(out).drop(*[f"__{r}" for r in rates])
