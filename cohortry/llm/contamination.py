"""Benchmark contamination: n-gram windows of test items found in documents."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, cut, fresh

#: Everything between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
TIMES = 20


def words_of(text: Column) -> Column:
    """Normalised words; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _stride(n: int) -> tuple[int, int]:
    """Any n consecutive words hold `length` words that start at a multiple of `step`."""
    step = max(1, (n + 2) // 3)
    return step, n - step + 1


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of the items: win (words), len, items (ids as strings)."""
    items = benchmark.select(F.col(item).cast("string").alias("__item"), words_of(F.col(text)).alias("__w")).where(F.size("__w") > 0)
    length = F.least(F.lit(n), F.size("__w"))
    starts = F.sequence(F.lit(1), F.size("__w") - length + 1)
    wins = items.select("__item", length.alias("len"), F.explode(F.transform(starts, lambda i: F.slice("__w", i, length))).alias("win"))
    return wins.groupBy("win", "len").agg(F.collect_set("__item").alias("items"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", order: str = "doc_id",
    item: str = "item_id", item_text: str = "text", block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each input row: order, n_words, n_hit, spans, items.

    spans holds [start, stop) word positions of the windows found, items the ids (strings, sorted)
    of the items they come from, n_hit the words within any span. A null text has no words; items
    without words are ignored; a long text is read whole; repeated rows give repeated results; a null id in benchmark counts
    for no item. Nothing is found if either table is empty.

    The windows' sub-windows are hashed and broadcast in blocks of at most block_bytes. The scan
    hashes sub-windows of documents at every few words only, which meets each window exactly once,
    and compares the full window where a hash is found.
    """
    wins = cut(benchmark_windows(benchmark, n, item, item_text))
    known = wins.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("i")).collect()  # n rows at most
    lengths = sorted(r["len"] for r in known) or [n]
    plan = F.array(*[F.struct(F.lit(x).alias("len"), F.lit(_stride(x)[0]).alias("step"), F.lit(_stride(x)[1]).alias("sub")) for x in lengths])
    size = sum(_stride(r["len"])[0] * (r["n"] * (24 * r["len"] + 80) + 24 * r["i"]) for r in known)
    blocks = max(1, ceil(size / block_bytes))

    step = F.create_map(*[F.lit(v) for x in lengths for v in (x, _stride(x)[0])])
    index = wins.select("*", F.explode(F.sequence(F.lit(0), step[F.col("len")] - 1)).alias("off"))
    index = index.withColumn("h", F.xxhash64(F.slice("win", F.col("off") + 1, F.col("len") - step[F.col("len")] + 1), F.col("len")))

    rows = docs.select(F.col(order).alias("__id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__key"), words_of(F.col(text)).alias("w"))
    rows = rows.select("__id", "__key", "w", F.size("w").alias("n_words"), F.explode(plan).alias("p"))
    last = F.col("n_words") - F.col("p.sub")
    probes = F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last, F.col("p.step")), lambda i: F.xxhash64(F.slice("w", i + 1, F.col("p.sub")), F.col("p.len")))
    ).otherwise(F.array().cast("array<bigint>"))
    # The first element stands for the row itself, so that one pass gives counts and hits.
    probed = rows.select("__id", "__key", "w", "n_words", "p.len", "p.step", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), probes)).alias("pos", "h"))

    # Each block hashes the texts anew: a probe carries its text's words by reference as long as it isn't written.
    found = None
    for k in range(blocks):
        part = index if blocks == 1 else index.where(F.pmod("h", F.lit(blocks)) == k)
        part = F.broadcast(part.select("h", "off", "win", "items", F.col("len").alias("of")))
        start = (F.col("pos") - 1) * F.col("step") - F.col("off")
        hit = F.col("win").isNotNull() & (F.col("of") == F.col("len")) & (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
        here = (F.col("pos") == 0) if k == 0 else F.lit(False)
        joined = probed.join(part, "h", "left").where(here | hit)
        joined = joined.select(
            "__id", "__key", "n_words", (here & (F.col("len") == lengths[0])).alias("here"),
            F.when(hit, F.struct(start.alias("start"), (start + F.col("len")).alias("stop"))).alias("span"), F.when(hit, F.col("items")).alias("items"),
        )
        found = joined if found is None else found.unionByName(joined)

    merged = found.groupBy("__id", "__key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if("here").alias("copies"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    covered = F.aggregate(
        F.array_sort("spans"), start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["stop"]))).alias("n"), F.greatest(a["stop"], x["stop"]).alias("stop")
        ),
        lambda a: a["n"],
    )
    out = merged.select(
        F.col("__id").alias(order), "n_words", covered.cast("long").alias("n_hit"), F.array_sort("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("__c"),
    )
    return out.select("*", F.explode("__c").alias("__k")).drop("__c", "__k")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie in windows of test items."""
    return (n_hit > 0) & (n_hit * TIMES >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, mode: str = "document", text: str = "text", order: str = "doc_id") -> DataFrame:
    """docs without contaminated documents (mode "document") or with the hit words cut out of their
    texts (mode "span": such a text becomes its other normalised words, joined by one space).

    Columns and clean rows stay as they were, null texts included. Ids should be unique; rows that share
    an id share its fate. A long text is read whole. Of an empty table nothing is left, and with an empty
    benchmark all stays.
    """
    found, bad, spans = find_contamination(docs, benchmark, n, text, order), fresh("__bad", docs.columns), fresh("__spans", docs.columns)
    if mode == "document":
        gone = found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col(order).alias(bad))
        return docs.join(gone, F.col(order).eqNullSafe(F.col(bad)), "left_anti")
    hits = found.where("n_hit > 0").groupBy(F.col(order).alias(bad)).agg(F.first("spans").alias(spans))
    kept = F.filter(words_of(F.col(text)), lambda w, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"])))
    cutout = F.when(F.col(spans).isNotNull(), F.array_join(kept, " ")).otherwise(F.col(text))
    return docs.join(hits, F.col(order).eqNullSafe(F.col(bad)), "left").select(*[cutout.alias(c) if c == text else F.col(c) for c in docs.columns])
