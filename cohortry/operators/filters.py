"""Optional filters: equality and minimum conditions that may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, equal: dict | None = None, minimum: dict | None = None, one_of: dict | None = None) -> DataFrame:
    """df where each given condition holds; a condition whose value is None is left out."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in (minimum or {}).items():
        df = df if v is None else df.where(F.col(c) >= v)
    for c, v in (one_of or {}).items():
        df = df if v is None else df.where(F.col(c).isin(list(v)))
    return df


def excluding(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_anti")


def first_groups(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """All rows of the first k groups by an order of one row a group."""
    firsts = df.groupBy(group).agg(F.min(F.struct(*order)).alias("__o")).orderBy("__o", group).limit(k).select(group)
    return df.join(F.broadcast(firsts), group, "left_semi")
