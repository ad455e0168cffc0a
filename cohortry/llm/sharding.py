"""Shards of nearly equal bytes by sampled splitters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, written

SHARDS = 8
#: Ranges the light rows are cut into, and keys drawn for each, on average.
RANGES, DRAWN = 64, 24
#: A group of equal texts of more than this part of a shard is placed by itself: at most SHARDS * 50 groups.
HEAVY = 0.02
#: Rows a cell holds at most, about: the rows a task sorts. Of very many rows a cell holds more, so that
#: there are no more than MOST_CELLS or so, and the tables of cells stay small at any size.
CELL_ROWS, MOST_CELLS = 200_000, 50_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes and one more; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _place(heavy: list[tuple[int, int]], shards: int, target: float) -> tuple[dict[int, list[tuple[int, float]]], list[float]]:
    """Shards for heavy groups, largest first into the emptiest: key -> [(shard, share of its bytes)], and what is
    left of each shard. Only a group larger than the room is subdivided."""
    room, placed = [target] * shards, {}
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        left, parts = float(size), []
        while left > 1e-9:
            s = max(range(shards), key=lambda i: (room[i], -i))
            take = left if left <= room[s] or room[s] <= 0 else room[s]
            parts.append((s, take / size))
            room[s] -= take
            left -= take
        placed[key] = parts
    return placed, room


def shards(docs: DataFrame, n: int = SHARDS, text: str = "text", keep: list[str] | None = None, ranges: int = RANGES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The columns `keep` of docs (all by default) with size, shard (0 to n - 1) and slot (gapless from 0 in each shard).

    Shards are nearly equal in bytes, and equal texts share a shard, unless their group is larger than
    the room a shard has left. A null text counts as the empty one; a long one goes where its bytes fit;
    repeated rows are rows like others and get slots of their own; an empty table gives an empty result;
    size, shard and slot replace columns of these names.

    Rows are keyed by a hash of the text. Keys are drawn with a chance in proportion to the row's size,
    quantiles of the draw are the splitters, and rows are range-partitioned by them. A range with more
    than cell_rows rows is subdivided by key, and a group of copies too large for a range, or of more
    rows than a cell, is taken out and subdivided by row. Exact sums over these cells give each cell the
    bytes before it, and a running sum within a cell gives each row its place.
    """
    spark, added = docs.sparkSession, ["size", "shard", "slot"]
    columns = [c for c in (keep or docs.columns) if c not in added]
    own = {f"__{i}": c for i, c in enumerate(columns)}
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # The tie orders equal texts; all columns take part, so that the order is the same in each run.
    rows = docs.select(*[F.col(c).alias(i) for i, c in own.items()], size_of(F.col(text)).alias("size"), key.alias("__key"), F.xxhash64(*columns).alias("__tie"))
    rows = written(rows)  # keyed once; all that follows reads the columns it needs
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    target, cell_rows = total / n, max(cell_rows, -(-count // MOST_CELLS))
    groups = rows.groupBy("__key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))  # combined in each task first
    heavy = {r[0]: (r[1], r[2]) for r in groups.where((F.col("size") > max(1.0, HEAVY * target)) | (F.col("rows") > cell_rows)).collect()}  # at most n / HEAVY + MOST_CELLS rows
    placed, room = _place([(k, size) for k, (size, _) in heavy.items()], n, target)

    # Cells of a heavy group: a few, by row, after all light cells.
    few, pieces = [], 0
    for k, (size, many) in sorted(heavy.items()):
        parts = max(1, math.ceil(size / max(1.0, total / (2 * ranges))), math.ceil(many / cell_rows))
        few.append((k, pieces, parts))
        pieces += parts
    owner = spark.createDataFrame(few, "__key long, __first int, __parts int")
    marked = rows.join(F.broadcast(owner), "__key", "left")  # as many rows as heavy groups
    light = marked.where("__parts is null")

    chance = F.least(F.col("size") * (ranges * DRAWN / max(total, 1)), F.lit(1.0))
    drawn = F.pmod(F.xxhash64("__key", F.lit("draw")), F.lit(1 << 40)) < chance * (1 << 40)
    keys = sorted(r[0] for r in light.where(drawn).select("__key").distinct().collect())  # about ranges * DRAWN rows
    splitters = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    coarse = F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s <= F.col("__key"))) if splitters else F.lit(0)

    # Subdivide overfull ranges: each becomes `parts` cells of equal width in the key.
    inside = {r["c"]: r["n"] for r in light.groupBy(coarse.alias("c")).agg(F.count("*").alias("n")).collect()}
    edges = [-(1 << 63), *splitters, 1 << 63]
    base, lows, widths = [0], [], []
    for c, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        parts = max(1, math.ceil(inside.get(c, 0) / cell_rows))
        lows.append(low >> 1)
        widths.append(((high >> 1) - (low >> 1)) // parts + 1)
        base.append(base[-1] + parts)
    light_cells = base[-1]
    at = lambda values: F.get(F.array(*map(F.lit, values)), coarse)
    offset = F.call_function("div", F.shiftright("__key", 1) - at(lows), at(widths)) if light_cells > len(lows) else F.lit(0)
    piece = F.lit(light_cells) + F.col("__first") + F.pmod("__tie", "__parts")
    celled = marked.withColumn("__cell", F.when(F.col("__parts").isNull(), at(base[:-1]) + offset).otherwise(piece).cast("int"))
    sums = {r["__cell"]: r["b"] for r in celled.groupBy("__cell").agg(F.sum("size").alias("b")).collect()}  # a row a cell

    def line(cells: range, ends: list[tuple[float, int]]) -> list[tuple]:
        """(cell, bytes before it, where the next shards begin, the shards) along a line of cells."""
        out, before = [], 0
        for c in cells:
            out.append((c, before, [float(e) for e, _ in ends], [s for _, s in ends]))
            before += sums.get(c, 0)
        return out

    def ends(shares: list[tuple[int, float]], size: float) -> list[tuple[float, int]]:
        out, at = [], 0.0
        for s, share in shares:
            at += share * size
            out.append((at, s))
        return out

    left = sum(max(0.0, x) for x in room) or 1.0
    light_bytes = sum(sums.get(c, 0) for c in range(light_cells))
    table = line(range(light_cells), ends([(s, max(0.0, x) / left) for s, x in enumerate(room)], light_bytes))
    for k, first, parts in few:
        table += line(range(light_cells + first, light_cells + first + parts), ends(placed[k], heavy[k][0]))
    cells = spark.createDataFrame(table, "__cell int, __before long, __ends array<double>, __to array<int>")

    ordered = Window.partitionBy("__cell").orderBy("__key", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    running = celled.withColumn("__run", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    # A light group goes where its first row goes, a subdivided heavy group goes row by row.
    group_start = F.min("__run").over(Window.partitionBy("__cell", "__key"))
    running = running.withColumn("__start", F.when(F.col("__cell") < light_cells, group_start).otherwise(F.col("__run")))
    joined = running.join(maybe_broadcast(cells, 200), "__cell")
    passed = F.size(F.filter("__ends", lambda e: e <= F.col("__before") + F.col("__start")))
    sharded = joined.withColumn("shard", F.get("__to", F.least(passed, F.size("__to") - 1)))
    sharded = written(sharded.select(*own, "size", "shard", "__cell", "__key", "__tie"))

    offsets, filled = [], {}
    for r in sorted(sharded.groupBy("shard", "__cell").count().collect(), key=lambda r: (r["shard"], r["__cell"])):  # cells, and n that straddle
        offsets.append((r["shard"], r["__cell"], filled.get(r["shard"], 0)))
        filled[r["shard"]] = filled.get(r["shard"], 0) + r["count"]
    shift = spark.createDataFrame(offsets, "shard int, __cell int, __offset long")
    within = F.row_number().over(Window.partitionBy("__cell", "shard").orderBy("__key", "__tie"))
    out = sharded.withColumn("__n", within).join(maybe_broadcast(shift, 48), ["shard", "__cell"])
    return out.select(*[F.col(i).alias(c) for i, c in own.items()], "size", "shard", (F.col("__offset") + F.col("__n") - 1).alias("slot"))
