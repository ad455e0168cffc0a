"""Lines that many documents share, found with levelled sorted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, cut, maybe_broadcast, written

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2
#: Ids drawn to cut the batches.
DRAWN = 1024


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hash(key: Column, min_chars: int) -> Column:
    """16 bytes for a key that is long enough, else null."""
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


class LineRuns:
    """Levels of sorted runs of (h, n, keeper): a line hash, the documents that hold it, the largest id.

    A batch must hold whole documents, with smaller ids than all earlier batches. So a line that a run
    has counted in min_docs documents is settled: its keeper is known, and the batch's merge-anti-join with
    the runs drops it. What is left is the batch's own run. When a level has `fanout` runs they are
    compacted to one run of the next level, which settles the lines counted in several.
    """

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.min_docs, self.fanout, self.levels = min_docs, fanout, []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        one = runs[0]
        for r in runs[1:]:
            one = one.unionByName(r)
        return one.groupBy("h").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")) if len(runs) > 1 else one

    def add(self, lines: DataFrame) -> None:
        """lines: (id, h), each pair once."""
        batch = lines.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        for run in self.runs():
            settled = run.where(F.col("n") >= self.min_docs).select("h")
            batch = batch.join(maybe_broadcast(settled, 32), "h", "left_anti")
        new = cut(batch.sortWithinPartitions("h"))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            new = cut(self.merged(self.levels[level]).sortWithinPartitions("h"))
            self.levels[level] = []
            level += 1


def repeated_lines(keyed: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h, keeper) of the lines that at least min_docs documents hold; keyed: (id, hashes), repeats allowed.
    A null id is smaller than any other, and keeper is null if only it holds the line."""
    some = keyed.where("id is not null").select("id").orderBy(F.xxhash64("id")).limit(DRAWN)
    ids = sorted((r[0] for r in some.collect()), reverse=True)  # at most DRAWN
    cuts = sorted({ids[i * len(ids) // batches] for i in range(1, batches)}, reverse=True) if ids else []
    runs = LineRuns(min_docs, fanout)
    for high, low in zip([None, *cuts], [*cuts, None], strict=True):
        part = keyed
        if high is not None:
            part = part.where(F.col("id").isNull() | (F.col("id") < high)) if low is None else part.where(F.col("id") < high)
        if low is not None:
            part = part.where(F.col("id") >= low)
        runs.add(part.select("id", F.explode("hashes").alias("h")).distinct())
    return LineRuns.merged(runs.runs()).where(F.col("n") >= min_docs).select("h", "keeper")


def dedup_lines(
    docs: DataFrame, text: str = "text", order: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """One row for each input row: order, text (without the dropped lines), n_lines, n_dropped.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of at least
    min_chars code points that at least min_docs documents hold lose all their lines but those in the
    document with the largest id. A null or empty text is one empty line; a long text is split whole. Ids
    may be of any type that can be ordered. Rows with the same id are one document for the counts; a null
    id counts as one document with the smallest id. An empty table gives an empty result.

    The hashes of the long enough lines are written once, by id; the batches and the drops read them.
    """
    rows = docs.select(F.col(order).alias("id"), F.col(text).alias("t"))
    hashes = F.array_distinct(F.array_compact(F.transform(lines_of(F.col("t")), lambda x: _hash(line_key(x), min_chars))))
    keyed = written(rows.select("id", hashes.alias("hashes")).where(F.size("hashes") > 0))
    repeated = cut(repeated_lines(keyed, min_docs, batches, fanout))
    held = keyed.select("id", F.explode("hashes").alias("h"))
    drops = held.join(maybe_broadcast(repeated, 48), "h").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_set("h").alias("drop"))
    drops = drops.withColumnRenamed("id", "__of")
    out = rows.join(drops, F.col("id").eqNullSafe(F.col("__of")), "left").withColumn("l", lines_of(F.col("t")))
    dropped = lambda x: F.coalesce(F.array_contains("drop", _hash(line_key(x), min_chars)), F.lit(False))
    kept = F.when(F.col("drop").isNull(), F.col("l")).otherwise(F.filter("l", lambda x: ~dropped(x)))
    out = out.select("id", "l", kept.alias("k"))
    return out.select(
        F.col("id").alias(order), F.array_join("k", "\n").alias(text), F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size("k")).cast("long").alias("n_dropped")
    )
