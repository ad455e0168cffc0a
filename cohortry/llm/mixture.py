"""Mixing sources to target weights: exact block quotas dealt over output shards by a hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, maybe_broadcast, written
from .exchange import mix as mixed_bits

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating, and times a source may be taken at most.
WEIGHTS, MOST = (1, 2, 3), 3
#: Words of a block, and blocks at most: of more words a block holds more.
BLOCK_WORDS, MOST_BLOCKS = 4096, 400_000_000
#: Shards at least, and words of a shard about.
SHARDS, SHARD_WORDS = 8, 1 << 27
#: Rows of a cell, the rows a task orders, and cells at most about; sources whose quotas one task splits.
CELL_ROWS, MOST_CELLS, SOURCES = 2_000, 1 << 20, 4096
SEED = 11


class Mixture(NamedTuple):
    #: (uid, doc, source, key, size, source_size, target): a row for each row of the input.
    rows: DataFrame
    #: (rank, source, weight, source_size, target, words, blocks): words is the target in whole words.
    sources: DataFrame
    #: (uid, key, rank, epoch, block, start, stop, shard, place): the words [start, stop) of a row that a shard takes.
    pieces: DataFrame
    shards: int


def size_of(text: Column) -> Column:
    """Number of words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(order: Column, text: Column) -> Column:
    """What a source's rows are permuted by: a digest of id and text, so that reruns and other layouts agree."""
    return F.md5(F.concat(F.coalesce(order.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank by code point, nulls last. The driver sees a count for each partition only."""
    order = F.col("source").asc_nulls_last()
    placed = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    part, offsets, before = F.shiftright("at", 33), [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    table = placed.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.join(F.broadcast(table), part == F.col("part")).withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources(source, source_size, ...) with rank, weight and target: shares by weight of all words, held at `most`
    times the source's own; what is over goes to the others by weight until none is above. All that are not held
    get one rate a weight, so each round is one sum over the sources."""
    table = F.array(*map(F.lit, weights))
    known = cut(_ranked(sources).withColumn("weight", F.get(table, F.pmod("rank", F.lit(len(weights))).cast("int"))))
    top = most * F.col("source_size")
    total, share = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rate, last = total / share if share else 0.0, None
    while rate != last:
        above = top < rate * F.col("weight")
        held, share = known.agg(F.coalesce(F.sum(F.when(above, top)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        rate, last = (total - held) / share if share else rate, rate
    return known.withColumn("target", F.least(top.cast("double"), rate * F.col("weight")))


def dealt(quotas: np.ndarray, rooms: np.ndarray, seed: tuple, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, blocks of each source) for shards with rooms[i] blocks, which are all blocks together: each node of the
    tree draws from its quotas what its left half of the shards gets, all ways to deal the blocks being equally
    likely. A node's draw depends on the seed and its place only."""
    if len(rooms) == 1:
        yield first, quotas
        return
    half = len(rooms) // 2
    rng = np.random.default_rng([*seed, first, len(rooms)])
    left = rng.multivariate_hypergeometric(quotas, int(rooms[:half].sum()), method="marginals") if quotas.sum() else quotas
    yield from dealt(left, rooms[:half], seed, first)
    yield from dealt(quotas - left, rooms[half:], seed, first + half)


def permuted(numbers: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """numbers in [0, size) permuted by a Feistel network of their own key, walked until they fall below size."""
    half = np.array([max(1, math.ceil(int(s - 1).bit_length() / 2)) for s in np.unique(size)], np.uint64)[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, walking = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(walking):
        h, m, k = half[walking], mask[walking], keys[walking]
        high, low = out[walking] >> h, out[walking] & m
        for turn in range(4):
            high, low = low, high ^ (mixed_bits(low + mixed_bits(k + np.uint64(turn))) & m)
        out[walking] = (high << h) | low
        walking = walking[out[walking] >= size[walking].astype(np.uint64)]
    return out.astype(np.int64)


def _drawn(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, block, shard, place): which shard takes each block, and where it stands there. Sources are dealt in
    groups: first the groups' totals over the shards, then each group's sources within its share of each shard."""
    spark, group = sources.sparkSession, F.call_function("div", F.col("rank"), F.lit(SOURCES))
    groups = sorted((r["g"], r["blocks"]) for r in sources.groupBy(group.alias("g")).agg(F.sum("blocks").alias("blocks")).collect())  # a row for 4,096 sources
    totals = np.array([n for _, n in groups], np.int64)
    everything = int(totals.sum())
    rooms = np.array([everything // shards + (i < everything % shards) for i in range(shards)], np.int64)
    shares = np.stack([x for _, x in dealt(totals, rooms, (seed, 0))], axis=1) if len(groups) else np.zeros((0, shards), np.int64)
    table = spark.createDataFrame([(g, shares[i].tolist()) for i, (g, _) in enumerate(groups)], "g long, rooms array<long>")

    def split(data):
        import pyarrow as pa

        data = data.sort_by("rank")
        quotas, rooms = data["blocks"].to_numpy().astype(np.int64), np.array(data["rooms"][0].as_py(), np.int64)
        rank, first, out = data["rank"].to_numpy(), np.zeros(len(quotas), np.int64), []
        for shard, take in dealt(quotas, rooms, (seed, 1 + int(data["g"][0].as_py()))):
            some = np.flatnonzero(take)
            out.append((rank[some], np.full(len(some), shard), first[some], take[some], quotas[some]))
            first = first + take
        names = ["rank", "shard", "first", "take", "blocks"]
        return pa.table({n: pa.array(np.concatenate([x[i] for x in out]).astype(np.int64)) for i, n in enumerate(names)})

    # A task takes what a shard draws from a source: no more than a shard's room.
    lots = written(sources.select("rank", "blocks", group.alias("g")).join(maybe_broadcast(table, 40 + 8 * shards), "g").groupBy("g").applyInArrow(split, "rank long, shard long, first long, take long, blocks long"))
    numbers = lots.repartition("rank", "shard").select("rank", "shard", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("take") - 1)).alias("number"))

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            rank, shard, blocks, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "shard", "blocks", "number"))
            key = mixed_bits(rank.astype(np.uint64) + mixed_bits(np.full(len(rank), seed, np.uint64)))
            block = permuted(number, blocks, key)
            place = mixed_bits(block.astype(np.uint64) + mixed_bits(key + np.uint64(99))) >> np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(block), pa.array(shard.astype(np.int32)), pa.array(place.astype(np.int64))], ["rank", "block", "shard", "place"])

    return numbers.mapInArrow(draw, "rank long, block long, shard int, place long")


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", order: str = "doc_id", shards: int | None = None, weights: tuple = WEIGHTS, most: int = MOST,
    block_words: int = BLOCK_WORDS, seed: int = SEED, cell_rows: int = CELL_ROWS,
) -> Mixture:
    """Which words of which rows each output shard takes, and in what order.

    Rows of a source are permuted by a digest of id and text, and stand in line `most` times; the first words of the
    line, as many as the source's target, are cut into blocks. Shards hold equally many blocks; how many of each source
    is drawn by a tree of multivariate hypergeometric splits, so quotas are met exactly; the blocks themselves come
    by a permutation of their numbers, and a shard's blocks stand in an order of their own. A source's words
    differ from its target by half a word at most; a row is taken `most` times at most, its last time perhaps
    in part.

    A null source is a source, the last one; a null text has no words and is taken nowhere, nor are texts of spaces;
    long texts are cut into pieces; repeated rows are rows of their own, told apart by nothing but their place; an
    empty table gives empty results. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(order).alias("doc"), F.col(source).alias("source"), key_of(F.col(order), F.col(text)).alias("key"), size_of(F.col(text)).alias("size"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(by_source, weights, most).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block_words = max(block_words, -(-total // MOST_BLOCKS))
    shards = shards or max(SHARDS, -(-total // SHARD_WORDS))
    sources = cut(sources.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long")))
    blocks = _drawn(sources.where("blocks > 0"), shards, seed)

    # Lines by cells of the key's range: a source of many rows has many cells.
    cell_rows = max(cell_rows, -(-count // MOST_CELLS))
    known = sources.select("rank", F.col("source").alias("__s"), "source_size", "target", "words", F.ceil(F.col("n") / cell_rows).alias("cells"))
    joined = rows.join(maybe_broadcast(known, 100), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    celled = joined.withColumn("cell", F.shiftright(place * F.col("cells"), 32))
    from pyspark.sql import Window

    within = Window.partitionBy("rank", "cell").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(celled.groupBy("rank", "cell").agg(F.sum("size").alias("size")))
    before = F.sum("size").over(Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("rank", "cell", F.coalesce(before, F.lit(0)).alias("offset"))
    running = celled.where("size > 0").select("uid", "key", "rank", "cell", "size", "source_size", "words", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("run"))
    lined = running.join(maybe_broadcast(offsets, 48), ["rank", "cell"]).withColumn("begin", F.col("offset") + F.col("run"))

    again = lined.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch")).withColumn("low", F.col("begin") + F.col("epoch") * F.col("source_size"))
    again = again.where("low < words").withColumn("high", F.least(F.col("low") + F.col("size"), F.col("words")))
    number = lambda c: F.call_function("div", c, F.lit(block_words))
    cut_up = again.select("uid", "key", "rank", "epoch", "low", "high", F.explode(F.sequence(number(F.col("low")), number(F.col("high") - 1))).alias("block"))
    start = F.greatest(F.col("low"), F.col("block") * block_words) - F.col("low")
    stop = F.least(F.col("high"), (F.col("block") + 1) * block_words) - F.col("low")
    pieces = cut_up.select("uid", "key", "rank", "epoch", "block", start.alias("start"), stop.alias("stop")).join(blocks, ["rank", "block"])
    pieces = pieces.select("uid", "key", "rank", "epoch", "block", "start", "stop", "shard", "place")
    return Mixture(joined.select("uid", "doc", "source", "key", "size", "source_size", "target"), sources.drop("n"), pieces, int(shards))


def taken(mixture: Mixture, order: str = "doc_id") -> DataFrame:
    """A row for each input row: order, size, source_size, target, and taken, its words in all shards."""
    words = mixture.pieces.groupBy("uid").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    out = mixture.rows.join(words, "uid", "left")
    return out.select(F.col("doc").alias(order), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shard_texts(docs: DataFrame, mixture: Mixture, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(shard, place, rank, block, doc, epoch, start, text): the mixed texts, each shard's blocks in their order there, a
    block's pieces in the order of its source's line. Words of a piece are joined by one space."""
    whole = docs.select(key_of(F.col(order), F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    placed = mixture.pieces.join(mixture.rows.select("uid", "doc"), "uid").join(whole, "key")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut_out = F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")), " ")
    out = placed.select("shard", "place", "rank", "block", "doc", "epoch", "start", cut_out.alias("text"), "key")
    return out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "rank", "block", "epoch", "key", "start").drop("key")
