"""Byte-level BPE encoding and decoding by a rank file."""

from __future__ import annotations

import base64
import struct

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces a task remembers before it sets them aside, and forgets those set aside before.
REMEMBERED = 120_000
#: Rows that a task encodes or decodes before it sends them on.
ROWS = 128
#: Nodes below one node of the tree of a piece.
FAN = 32
#: Above every rank: of a pair that no token is.
NO_RANK = 1 << 40


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver (its size is that of a vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece.

    A segment tree over byte positions holds at each leaf the rank of the live pair that starts there,
    packed with the position, so its root is the leftmost pair of the lowest rank. A merge updates the
    leaves of the merged pair, of the one before and of the part that is gone. A node has up to FAN below
    it, whose minimum is one call: a word's tree is its leaves and the root, a long piece's is still low.
    """
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    shift = n.bit_length()
    mask, none = (1 << shift) - 1, NO_RANK << shift
    get = ranks.get
    leaves = [get(piece[i : i + 2], NO_RANK) << shift | i for i in range(n - 1)]
    leaves.append(none)
    top, levels = leaves, []
    while len(top) > FAN:
        below, top = top, [min(top[i : i + FAN]) for i in range(0, len(top), FAN)]
        levels.append((below, top))
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (low := min(top)) < none:
        i = low & mask
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        leaves[gone] = none
        leaves[i] = get(piece[i : after[end]], NO_RANK) << shift | i if end < n else none
        j = before[i]
        if j >= 0:
            leaves[j] = get(piece[j:end], NO_RANK) << shift | j
        if levels:
            for at in (gone, i, max(j, 0)):
                _lift(levels, at)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


def _lift(levels: list[tuple[list[int], list[int]]], at: int) -> None:
    """Renews the minima above leaf at, up to one that holds already."""
    for below, above in levels:
        at //= FAN
        low = min(below[at * FAN : (at + 1) * FAN])
        if above[at] == low:
            return
        above[at] = low


class Pieces(dict):
    """Piece of text to its token ids, as the bytes of int32, filled as needed.

    Full, it sets its pieces aside and takes back those asked for again, until it is full once more. So the
    frequent ones stay, and no more than twice `remembered` are held.
    """

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        super().__init__()
        self.ranks, self.remembered, self.aside = ranks, remembered, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.aside.pop(piece, None)
        if ids is None:
            found = merge_piece(piece.encode("utf-8"), self.ranks)
            ids = struct.pack(f"={len(found)}i", *found)
        if len(self) >= self.remembered:
            self.aside = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _encoder(raw: Broadcast, pattern: str, at: int, names: list[str]):
    """Batches with the text at place at, to batches with its ids as one more column, all called names."""

    def run(batches):
        import pyarrow as pa
        import regex

        pieces, findall = Pieces(parse_ranks(raw.value)), regex.compile(pattern).findall
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                found = [b"".join(map(pieces.__getitem__, findall(t.as_py() or ""))) for t in part.column(at)]
                ends = np.cumsum([0, *[len(x) // 4 for x in found]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names)

    return run


def _decoder(raw: Broadcast, at: int, names: list[str]):
    """Batches with ids at place at, to batches with their bytes as one more column, all called names."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = {rank: token for token, rank in parse_ranks(raw.value).items()}
        unknown = max(table, default=-1) + 1  # the place after the last id, of no bytes
        lengths = np.array([len(table.get(i, b"")) for i in range(unknown + 1)], np.int64)
        starts, blob = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(table.get(i, b"") for i in range(unknown)), np.uint8)
        del table
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                column = part.column(at)
                flat = pc.fill_null(column.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
                flat = np.where((flat < 0) | (flat > unknown), unknown, flat)
                sizes = lengths[flat]
                ends = np.cumsum(sizes)
                total = int(ends[-1]) if len(ends) else 0
                text = blob[np.repeat(starts[flat] - (ends - sizes), sizes) + np.arange(total)]
                counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(text.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, data], names)

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with one more column, the token ids (array<int>); out replaces a column of that name.

    The ids are those of byte-pair merging by rank within each match of pattern, without special tokens.
    A null or empty text has no ids; a long text is encoded whole, piece by piece; repeated rows give
    repeated results; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*[docs[c] for c in kept]).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    raw = docs.sparkSession.sparkContext.broadcast(ranks)
    return docs.select(*[docs[c] for c in kept]).mapInArrow(_encoder(raw, pattern, kept.index(text), [*kept, out]), schema)


def decode(docs: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with one more column, the bytes of the ids in order (binary); out replaces a column of that name.

    No bytes stand for null, an empty list, a null among the ids, and ids that the vocabulary lacks,
    negative ones included. Repeated rows give repeated results; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*[docs[c] for c in kept]).schema.fields, T.StructField(out, T.BinaryType())])
    raw = docs.sparkSession.sparkContext.broadcast(ranks)
    return docs.select(*[docs[c] for c in kept]).mapInArrow(_decoder(raw, kept.index(ids), [*kept, out]), schema)


def encode_and_decode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs without the text, with its ids as of encode and the bytes of these as of decode; both replace columns
    of their names. One Python worker does both, so that a core holds one, not two."""
    rest = [c for c in docs.columns if c not in (text, ids, out)]
    schema = T.StructType([*docs.select(*[docs[c] for c in rest]).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(out, T.BinaryType())])
    raw = docs.sparkSession.sparkContext.broadcast(ranks)
    encoded, decoded = _encoder(raw, pattern, len(rest), [*rest, text, ids]), _decoder(raw, len(rest), [*rest, ids, out])

    def run(batches):
        return decoded(b.drop_columns([text]) for b in encoded(batches))

    return docs.select(*[docs[c] for c in rest], docs[text]).mapInArrow(run, schema)
