"""Claims about entities with levels, qualifiers, provenance and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import bands, short_id

LEVELS = [(80, "Elite"), (70, "Strong"), (60, "Above Average"), (45, "Average")]


def capability_claims(tall: DataFrame, entity: str, fingerprint: str) -> DataFrame:
    """A claim for each score of an entity: claim_id, level and confidence from the sample (column n)."""
    predicate = F.concat_ws(":", F.lit("capability"), F.col("capability"))
    return tall.select(
        short_id(F.col(entity).cast("string"), predicate, F.lit(fingerprint)).alias("claim_id"), F.col(entity), F.lit("capability").alias("claim_type"), "capability", "score",
        bands(F.col("score"), LEVELS, "Below Average").alias("level"), F.when(F.col("n") >= 10, "high").when(F.col("n") >= 5, "medium").otherwise("low").alias("confidence"),
    )


def qualifiers(rules: list[tuple[str, str, Column]]) -> Column:
    """kind:severity of the rules that hold; of several rules of one kind the first."""
    kinds = dict.fromkeys(k for k, _, _ in rules)
    out = []
    for kind in kinds:
        value = None
        for k, severity, c in rules:
            if k == kind:
                label = F.lit(f"{k}:{severity}")
                value = F.when(c, label) if value is None else value.when(c, label)
        out.append(value)
    return F.array_compact(F.array(*out))


def sample_rules(matches: str, minutes: str) -> list[tuple[str, str, Column]]:
    n = F.col(matches)
    return [
        ("sample_size", "material", n < 3), ("sample_size", "cautionary", n < 5), ("sample_size", "informational", n < 10),
        ("minutes", "cautionary", F.col(minutes) < 450),
    ]


#: Competitions that are no league.
NO_LEAGUE = ["Multiple", "All Competitions Career"]


def context_rules(league: Column, over: Column, goals: Column, gated: Column, position: Column, positions: list[str], most: float = 2.0) -> list[tuple[str, str, Column]]:
    """League context, regression risk of an overperformance `over` on few goals, a signal `gated` on
    positions that this one isn't of, and overperformance beyond most."""
    return [
        ("league_context", "informational", ~league.isin(NO_LEAGUE)), ("regression_risk", "cautionary", (over > 0) & (goals < 5)),
        ("role_dependence", "informational", gated & ~position.isin(positions)), ("overperformance", "informational", over > most),
    ]


def provenance(engine: str, fingerprint: str, rules: list[str], version: str = "1") -> Column:
    """Where a claim comes from: engine, version, fingerprint of its input, rules applied."""
    return F.struct(F.lit(engine).alias("engine"), F.lit(version).alias("version"), F.lit(fingerprint).alias("fingerprint"), F.array(*[F.lit(r) for r in rules]).alias("rules"))


def coverage(sought: DataFrame, found: DataFrame, key: str, optional: list[str] = ()) -> DataFrame:
    """For each question: the claim types sought, found and missing, whether complete, and whether valid without the optional ones."""
    s = sought.groupBy(key).agg(F.array_sort(F.collect_set("claim_type")).alias("sought"))
    f = found.groupBy(key).agg(F.array_sort(F.collect_set("claim_type")).alias("found"))
    j = s.join(f, key, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    missing = F.array_except("sought", "found")
    needed = F.array_except(missing, F.array(*[F.lit(x) for x in optional]).cast("array<string>"))
    return j.select(
        key, F.size(F.array_intersect("sought", "found")).cast("long").alias("n_satisfied"), F.array_join(missing, ",").alias("missing"),
        (F.size(missing) == 0).alias("complete"), (F.size(needed) == 0).alias("valid"),
    )


def bundles(intents: DataFrame, claims: DataFrame, on: list[str], key: str) -> DataFrame:
    """The claims each intent asks for, grouped: key, n_claims, claim_ids."""
    return intents.join(claims, on).groupBy(key).agg(F.count("*").alias("n_claims"), F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("claim_ids"))
