"""Compression of vectors to short codes: a codebook for each part of a vector, searched by equal averages."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


@dataclass(frozen=True)
class Codebooks:
    """entries[p][j]: the integers of entry j of part p; dim: components of a vector, before any padding."""

    entries: np.ndarray
    dim: int
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in book of each part's nearest entry (squared distance, ties to the lower index), and the distance.

    The sum of a part's components differs from that of an entry at distance D by the square root of D times
    the width at most. So entries are sorted by sum and tried outward from the part's own sum, the smaller
    gap first, until the gap's square over the width strictly exceeds the best distance.
    """
    width, size = parts.shape[1], len(book)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, book, own = sums[order], book[order], parts.sum(axis=1)
    high = np.searchsorted(sums, own)  # the next entry above, and below it the next one below
    low = high - 1
    far = np.int64(1) << 31  # no two sums differ by as much
    at, best = np.full(len(parts), size, np.int64), np.full(len(parts), far * far // width, np.int64)
    active = np.arange(len(parts))
    while len(active):
        h, d = high[active], low[active]
        above = np.where(h < size, sums[np.minimum(h, size - 1)] - own[active], far)
        below = np.where(d >= 0, own[active] - sums[np.maximum(d, 0)], far)
        down = below < above
        gap = np.where(down, below, above)
        on = (gap < far) & (gap * gap <= width * best[active])
        active, place, down = active[on], np.where(down, d, h)[on], down[on]
        away = parts[active] - book[place]
        distance, entry = np.einsum("ij,ij->i", away, away), order[place]
        better = (distance < best[active]) | (distance == best[active]) & (entry < at[active])
        won = active[better]
        best[won], at[won] = distance[better], entry[better]
        low[active] -= down
        high[active] += ~down
    return at, best


def _largest(width: int) -> int:
    """Integers up to which squares of sums over a part fit a long."""
    return (1 << 29) // width


def _whole(vectors, dim: int, parts: int, scale: int) -> np.ndarray:
    """An Arrow list column as integers (row, part, position)."""
    width = -(-dim // parts)
    out = np.zeros((len(vectors), parts * width), np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    largest = _largest(width)
    out[:, :dim] = np.clip(np.floor(values * scale), -largest, largest)
    return out.reshape(len(vectors), parts, width)


def _assigned(whole: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (row, part), and distances."""
    found = [nearest(whole[:, p], entries[p]) for p in range(len(entries))]
    return np.stack([x[0] for x in found], axis=1), np.stack([x[1] for x in found], axis=1)


def _summed(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(slot, at, value): for each entry (part * entries + index) the sums of its parts, and their number at -1."""
    parts, size, width = books.entries.shape

    def run(batches):
        import pyarrow as pa

        totals = np.zeros((width + 1, parts * size), np.int64)
        for batch in batches:
            whole = _whole(batch.column(0), books.dim, parts, books.scale)
            slots = (_assigned(whole, books.entries)[0] + np.arange(parts) * size).ravel()
            totals[0] += np.bincount(slots, minlength=parts * size)
            for i in range(width):  # a batch's sums are exact as doubles
                totals[i + 1] += np.bincount(slots, whole[:, :, i].ravel(), parts * size).astype(np.int64)
        used = np.flatnonzero(totals[0])
        at = np.repeat(np.arange(-1, width, dtype=np.int32), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(used, width + 1).astype(np.int32)), pa.array(at), pa.array(totals[:, used].ravel())], ["slot", "at", "value"])

    partial = vectors.mapInArrow(run, "slot int, at int, value long")
    return partial.groupBy("slot", "at").agg(F.sum("value").alias("value"))


def train(
    rows: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks:
    """Codebooks of the usable vectors of rows, learned from all of them.

    Each part's book starts as that part of the `entries` smallest ids (nulls last, then by vector); each
    round assigns every part to its nearest entry and moves each entry to the floored mean of its parts.
    Entries without parts stay. With fewer vectors there are fewer entries, with none the books are empty.
    The driver gets sums by entry, entries x (components + parts) numbers, whatever the number of rows.

    A vector is as long as the first of them; others are no vectors of this table and are left out. If the
    length isn't a multiple of parts, zeros stand behind it. Integers are held within 2**29 over the width.
    """
    kept = rows.where(usable(F.col(vector)) & (F.size(vector) > 0)).select(F.col(order).alias("__id"), F.col(vector).cast("array<double>").alias("__v"))
    first = [r["__v"] for r in kept.orderBy(F.col("__id").asc_nulls_last(), "__v").limit(entries).collect()]
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), 0, scale)
    dim = len(first[0])
    if any(len(v) != dim for v in first):
        kept = kept.where(F.size("__v") == dim)
        first = [r["__v"] for r in kept.orderBy(F.col("__id").asc_nulls_last(), "__v").limit(entries).collect()]
    width = -(-dim // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    start[:, :dim] = np.clip(np.floor(np.array(first) * scale), -_largest(width), _largest(width))
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)), dim, scale)
    same = kept.where(F.size("__v") == dim).select("__v")
    for _ in range(rounds):
        moved, sums = books.entries.copy(), {(r["slot"], r["at"]): r["value"] for r in _summed(same, books).collect()}
        for (slot, i), value in sums.items():
            if i >= 0:
                moved[slot // len(first), slot % len(first), i] = value // sums[slot, -1]
        books = Codebooks(moved, dim, scale)
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The usable rows with code (two hexadecimal digits a part; four if there are over 256 entries) and error,
    the squared distances summed over the parts. Columns of these names are replaced, all others stay, the
    vector too. Vectors of another length than the books' have no code and are left out, like those that hold
    nulls, infinities or no numbers; repeated rows are coded alike; of an empty table nothing is left."""
    parts, dim = len(books.entries), books.dim
    digits = 2 if books.entries.shape[1] <= 256 else 4
    kept = rows.where(usable(F.col(vector)) & (F.size(vector) == dim) & F.lit(dim > 0))
    kept = kept.select(*[c for c in kept.columns if c not in (code, error) or c == vector])
    numbers = fresh("__v", kept.columns)
    asked = kept.withColumn(numbers, F.col(vector).cast("array<double>"))
    schema = T.StructType([*kept.schema.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            whole = _whole(batch.column(batch.num_columns - 1), dim, parts, books.scale)
            at, away = _assigned(whole, books.entries)
            text = at.astype(">u1" if digits == 2 else ">u2").tobytes().hex()
            step = parts * digits
            codes = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes, pa.array(away.sum(axis=1))], schema.names)

    return asked.mapInArrow(run, schema)


def decode(rows: DataFrame, books: Codebooks, code: str = "code", out: str = "decoded") -> DataFrame:
    """rows with the vector that each code stands for: the middles of the entries' steps. A null code gives null."""
    digits = 2 if books.entries.shape[1] <= 256 else 4
    middle = (books.entries + 0.5) / books.scale
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in entry]) for entry in book]) for book in middle])
    part = lambda p: F.conv(F.substring(F.col(code), p * digits + 1, digits), 16, 10).cast("int")
    pieces = [F.get(F.get(tables, F.lit(p)), part(p)) for p in range(len(middle))]
    return rows.withColumn(out, F.slice(F.concat(*pieces), 1, max(books.dim, 1)))


def label_errors(coded: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """coded with the error summed over the rows of equal labels, nulls together. The sums are made in each task
    first; they are joined as a table of their own, so that a label of many rows can be split."""
    from .common import cut, maybe_broadcast

    name, total = fresh("__label", coded.columns), fresh("__total", coded.columns)
    sums = cut(coded.groupBy(F.col(label).alias(name)).agg(F.sum(error).alias(total)))
    joined = coded.join(maybe_broadcast(sums, 64), F.col(label).eqNullSafe(F.col(name)), "left")
    return joined.select(*[c for c in coded.columns if c != out], F.col(total).alias(out))
