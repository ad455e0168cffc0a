"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, maybe_broadcast

#: Rows of a digest group in one salt, about: a group of n rows is dealt over n / HOT_ROWS salts.
HOT_ROWS = 512


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame, text: str = "text", order: str = "doc_id", digest=sha256, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row for each input row: order, keep_id, group_size, kept, digest.

    Rows are equal if their texts are identical; a null text equals the empty one. Of equal rows
    the one with the largest order value stays; a null order value is smaller than any other, and of
    rows with the same order value all are marked as kept. An empty table gives an empty result.

    Texts of any length are compared whole; other columns of docs play no part.

    A text whose digest occurs once is unique. The others are combined in three steps: each task
    combines its own rows, then the salted groups of a digest, then the winners of the salts. Each
    step groups by digest and full text, so equal digests of different texts do no harm.
    """
    rows = docs.select(F.col(order).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__digest", digest(F.col("__text")))
    repeated = cut(
        rows.groupBy("__digest").agg(F.count("*").alias("__n")).where("__n > 1")  # combined in each task first
    )
    marked = rows.join(maybe_broadcast(repeated, 120), "__digest", "left")
    unique = marked.where("__n is null").select(
        "__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "__digest"
    )
    salts = F.ceil(F.col("__n") / hot_rows)
    shared = marked.where("__n is not null").withColumn("__salt", F.pmod(F.xxhash64("__id"), salts))
    salted = shared.groupBy("__digest", "__n", "__salt", "__text").agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.groupBy("__digest", "__n", "__text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    dealt = winners.select("__digest", "__text", "keep_id", "group_size", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("__salt"))
    members = shared.join(dealt, ["__digest", "__salt", "__text"])
    out = unique.unionByName(members.select("__id", "keep_id", "group_size", "__digest"))
    return out.select(
        F.col("__id").alias(order), "keep_id", "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("__digest").alias("digest"),
    )


def drop_copies(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """docs without the rows that exact_groups marks as dropped; columns as they were.

    Rows equal in both order and text share their fate, so repeats of a kept row stay; nulls, empty and
    long texts and empty tables as in exact_groups.
    """
    kept, same_id, digest = exact_groups(docs, text, order), fresh("__id", docs.columns), fresh("__digest", docs.columns)
    kept = kept.where("kept").select(F.col(order).alias(same_id), F.col("digest").alias(digest))
    same = F.col(order).eqNullSafe(F.col(same_id)) & (sha256(F.coalesce(F.col(text), F.lit(""))) == F.col(digest))
    return docs.join(kept, same, "left_semi")
