"""Data-quality rules: named predicates over a table, with a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    level: str  # "error" or "warning"
    broken: Column


#: The keys that a record of each kind must have.
REQUIRED_KEYS = {
    "competition": ["competition_id", "competition_name", "season_id", "season_name"],
    "match": ["match_id", "match_date", "home_team", "away_team", "home_score", "away_score"],
    "event": ["id", "index", "type", "minute", "second"],
    "lineup": ["team_id", "team_name", "lineup"],
}
#: Whether a missing column is an error or a warning, by kind of table.
MISSING_LEVEL = {"competition": "error", "match": "warning", "event": "warning", "lineup": "error"}


def key_faults(records: DataFrame, kind: str) -> DataFrame:
    """records(file, record) with missing, those of the kind's required keys that a record lacks (C2): all of them if it
    is no object. A key whose value is null is there. Rows without a record are left out."""
    keys = F.coalesce(F.json_object_keys("record"), F.array().cast("array<string>"))
    required = F.array(*map(F.lit, REQUIRED_KEYS[kind]))
    return records.where(F.col("record").isNotNull()).select("file", "record", F.array_except(required, keys).alias("missing"))


def column_faults(df: DataFrame, kind: str, declared: dict[str, str]) -> DataFrame:
    """(dataset, level, column, found, declared): columns of a table that are missing or of another type than declared
    (C9). Only the schema is looked at."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(kind, MISSING_LEVEL[kind] if c not in found else "warning", c, found.get(c), t) for c, t in declared.items() if found.get(c) != t]
    return df.sparkSession.createDataFrame(rows, "dataset string, level string, column string, found string, declared string")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def null_rule(column: str, level: str = "error") -> Rule:
    return Rule(f"null_{column}", level, F.col(column).isNull())


def repeat_rule(keys: list[str], order: list[str], level: str = "error") -> Rule:
    """Each repeat of a key after its first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return Rule("repeated_" + "_".join(keys), level, F.row_number().over(w) > 1)


def range_rule(name: str, broken: Column, level: str = "error") -> Rule:
    return Rule(name, level, broken)


def required_rule(label: str, columns: list[str], level: str = "error") -> Rule:
    """A record that lacks one of its required keys (C2): the columns parsed from them are null."""
    return Rule(f"missing_keys_{label}", level, F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x))


def group_sizes(df: DataFrame, key: str, value: str, expected: int) -> DataFrame:
    """(key, n): the groups that don't hold exactly `expected` different values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).where(F.col("n") != expected)


def first_files(df: DataFrame, file: str, most: int = 20) -> DataFrame:
    """The rows of the first `most` files by name, for a sampled validation (C10): as many names go through the driver."""
    names = [r[0] for r in df.select(file).distinct().orderBy(file).limit(most).collect()]
    return df.where(F.col(file).isin(names))


def report(df: DataFrame, rules: list[Rule], dataset: str) -> DataFrame:
    """One row: totals, clean rows, counts by level, validity in percent, and each rule's count."""
    flags = df.select(*[F.coalesce(r.broken, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)])
    error = [F.col(f"r{i}") for i, r in enumerate(rules) if r.level == "error"]
    warning = [F.col(f"r{i}") for i, r in enumerate(rules) if r.level == "warning"]
    either = lambda xs: F.exists(F.array(*xs), lambda x: x) if xs else F.lit(False)
    out = flags.agg(
        F.count("*").alias("total"), F.count_if(~either(error)).alias("clean"), F.count_if(either(error)).alias("errors"), F.count_if(either(warning)).alias("warnings"),
        *[F.count_if(F.col(f"r{i}")).alias(r.name) for i, r in enumerate(rules)],
    )
    validity = F.when(F.col("total") > 0, F.floor(F.col("clean") * 1000.0 / F.col("total") + 0.5) / 10.0).otherwise(0.0)
    return out.select(F.lit(dataset).alias("dataset"), "*", (F.col("errors") == 0).alias("is_valid"), validity.alias("validity_pct"))


def first_failures(df: DataFrame, rules: list[Rule], key: str, most: int = 10) -> DataFrame:
    """(rule, level, key) of the first `most` rows that break each rule: a report for people to read."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"__r{i}"), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"))) for i, r in enumerate(rules)]))
    flagged = df.withColumns({f"__r{i}": r.broken for i, r in enumerate(rules)})
    tall = flagged.select(key, F.explode(found).alias("f")).select("f.rule", "f.level", key)
    w = Window.partitionBy("rule").orderBy(key)
    return tall.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def lineage(stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """How each key went through the stages, in one grouping: key, stages (names of those that have it), lost (the first
    that has not, after one that has; null if none), rows (most rows of the key in a stage) and differences, an
    array of (column, before, after, stage) where a column that two successive stages share has other values.

    Values are compared as text, nulls being equal to one another only; a key with several rows in a stage is
    compared by its least row of values. A null key is a key.
    """
    names, shared = [n for n, _ in stages], []
    for (_, a), (_, b) in zip(stages, stages[1:], strict=False):
        shared.append([c for c in a.columns if c != key and c in b.columns])
    used = sorted({c for cs in shared for c in cs})
    parts = None
    for i, (_, df) in enumerate(stages):
        values = F.struct(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in used]) if used else F.struct(F.lit(1).alias("none"))
        part = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min(values).alias("v")).withColumn("i", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    # A row for each stage at most, so that a key's group is as small as the chain.
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}")
    wide = parts.groupBy("key").agg(*[at(i, c) for i in range(len(stages)) for c in ("n", "v")])
    has = [F.col(f"n{i}").isNotNull() for i in range(len(stages))]
    lost, seen = F.lit(None).cast("string"), F.lit(False)
    for i, name in enumerate(names):
        lost = F.when(lost.isNull() & seen & ~has[i], F.lit(name)).otherwise(lost)
        seen = seen | has[i]
    found = []
    for i, cs in enumerate(shared):
        for c in cs:
            a, b = F.col(f"v{i}")[c], F.col(f"v{i + 1}")[c]
            found.append(F.when(has[i] & has[i + 1] & ~a.eqNullSafe(b), F.struct(F.lit(c).alias("column"), a.alias("before"), b.alias("after"), F.lit(names[i + 1]).alias("stage"))))
    differences = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<column:string,before:string,after:string,stage:string>>")
    return wide.select(
        F.col("key").alias(key), F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, n in zip(has, names, strict=True)])).alias("stages"), lost.alias("lost"),
        F.greatest(*[f"n{i}" for i in range(len(stages))] + ["n0"]).alias("rows"), differences.alias("differences"),
    )
