"""Passages of many words that occur elsewhere, found by parsing documents into factors of reference blocks."""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import bucketed

WINDOW = 35
#: Words of an anchor at most. Any odd number as base: its powers are then invertible modulo 2**64.
ANCHOR, _BASE = 4, 0x9E3779B97F4A7C15
#: Stretches a reference block holds about; stretches of one anchor above which its windows are dealt by their own words.
PART_STRETCHES, HOT = 1 << 15, 2048
_LOW = np.uint64(0xFFFFFFFF)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + size), one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _split(texts: list) -> list[list[bytes]]:
    """Words by text: what splitting at the six white-space bytes leaves."""
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]


class Stretches:
    """The words of a block's texts, and its windows of n words by anchor.

    The anchor of a window is its k-gram with the least hash, the leftmost in a tie. Equal windows have
    equal anchors at the same place, wherever they stand. Consecutive windows that share an anchor make a
    stretch of the text (`begin`, `end`: word positions), and any two equal windows lie in stretches of
    equal `key`. Keys only bring stretches together; words are numbered exactly and compared.
    """

    def __init__(self, texts: list, n: int, bits: int = 64):
        import pyarrow as pa
        import xxhash

        words = _split(texts)
        sizes = np.array([len(w) for w in words], np.int64)
        coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
        self.n, self.vocabulary, self.ids = n, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.hashes = hashes = X.mix(table & np.uint64((1 << bits) - 1))[self.ids]
        size, k = len(hashes), min(ANCHOR, max(1, n // 2))
        self.begin = self.end = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        room = np.repeat(np.cumsum(sizes), sizes)[: max(0, size - n + 1)] - np.arange(max(0, size - n + 1))
        starts = np.flatnonzero(room >= n)
        if not len(starts):
            return
        grams = np.zeros(size - k + 1, np.uint64)
        for i in range(k):
            grams = X.mix(grams + hashes[i : i + len(grams)])
        least, span, reach = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), 1, n - k + 1
        while span < reach:
            step = min(span, reach - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        anchor = (least[starts] & _LOW).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        self.begin, self.end = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + n
        self.key = grams[anchor[cut]]

    def prints(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit print of the words [begin, end) each: differences of a polynomial's prefix sums."""
        size = len(self.hashes)
        powers = np.full(size, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(self.hashes * powers)])
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return X.mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))

    def asked(self, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, route) of what may occur elsewhere, given 0, 1 or 2 (hot) for each stretch."""
        plain, hot = verdict == 1, np.flatnonzero(verdict == 2)
        count = self.end[hot] - self.begin[hot] - self.n + 1
        single = _ranges(self.begin[hot], count)
        begin, end = np.concatenate([self.begin[plain], single]), np.concatenate([self.end[plain], single + self.n])
        route = self.key[plain]
        if len(single):
            route = np.concatenate([route, X.mix(np.repeat(self.key[hot], count) + self.prints(single, single + self.n))])
        return begin, end, route

    def distinct(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each stretch the first one of the same words: found by print, confirmed by the words."""
        _, index, inverse = np.unique(self.prints(begin, end), return_index=True, return_inverse=True)
        first, own = index[inverse], np.arange(len(begin))
        other = np.flatnonzero(first != own)
        sizes, there = (end - begin)[other], first[other]
        same = sizes == (end - begin)[there]
        first[other[~same]] = other[~same]
        other, sizes, there = other[same], sizes[same], there[same]
        if len(other):
            unlike = self.ids[_ranges(begin[other], sizes)] != self.ids[_ranges(begin[there], sizes)]
            wrong = other[np.add.reduceat(unlike, np.cumsum(sizes) - sizes) > 0]
            first[wrong] = wrong
        return first


def longest_matches(words: np.ndarray, depth: int) -> np.ndarray:
    """For each position the length of the longest match that starts at any other one.

    The suffixes are sorted by doubling the words compared up to depth; a suffix's longest match is the
    longer of those with its neighbours in that order, read off the ranks of the doublings.
    """
    ranks, step = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    size = len(words)
    while step < depth:
        after = np.zeros(size, np.int64)
        after[: max(0, size - step)] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (size + 1) + after, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, length = order[:-1], order[1:], np.zeros(max(0, size - 1), np.int64)
    for level in reversed(range(len(ranks))):
        x, y = np.minimum(a + length, size - 1), np.minimum(b + length, size - 1)
        length += (ranks[level][x] == ranks[level][y]).astype(np.int64) << level
    out = np.zeros(size, np.int64)
    out[a] = length
    out[b] = np.maximum(out[b], length)
    return out


def repeated_windows(longest: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of a window with a match in each stretch, last < first if it has none.

    Each stretch is factored greedily: a factor is the longest match at its start, the next one follows it.
    Windows inside a factor of n words or more occur elsewhere; those that no such factor holds, at its
    boundaries above all, are asked for their own match.
    """
    last_start, at = begin + size - n, begin.copy()
    first, last = np.full(len(begin), np.iinfo(np.int64).max), np.full(len(begin), -1)
    known = np.zeros(len(longest) + 1, np.int32)
    live = np.arange(len(begin))
    while len(live):
        here = at[live]
        length = np.maximum(longest[here], 1)
        long = length >= n
        rows, lo = live[long], here[long]
        hi = np.minimum(lo + length[long] - n, last_start[rows])
        first[rows] = np.minimum(first[rows], lo)
        last[rows] = np.maximum(last[rows], hi)
        known[lo] += 1
        known[hi + 1] -= 1
        at[live] = here + length
        live = live[at[live] <= last_start[live]]
    counts = size - n + 1
    starts, owner = _ranges(begin, counts), np.repeat(np.arange(len(begin)), counts)
    rest = (np.cumsum(known[:-1])[starts] == 0) & (longest[starts] >= n)
    np.minimum.at(first, owner[rest], starts[rest])
    np.maximum.at(last, owner[rest], starts[rest])
    return first, last


def _parsed(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    """One reference block: the stretches of all documents' blocks that share its anchors. Each is parsed
    against all others; (block, starts, sizes) are the passages found, in the words of the asking block."""
    import pyarrow as pa

    vocabularies = [zlib.decompress(x).split(b" ") for x in pdf["vocabulary"]]
    numbers = pa.array(list(chain.from_iterable(vocabularies)), pa.binary()).dictionary_encode()
    known = numbers.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bases = np.cumsum([0, *map(len, vocabularies)])
    ids = np.concatenate([known[base + X.unpack_planes(x)] for base, x in zip(bases, pdf["ids"])])
    per_row = [X.unpack_planes(x).astype(np.int64) for x in pdf["sizes"]]
    counts = np.concatenate([X.unpack_planes(x).astype(np.int64) for x in pdf["counts"]])
    size = np.concatenate(per_row)
    begin = np.cumsum(size + 1) - (size + 1)
    words = np.empty(int(size.sum()) + len(size), np.int64)
    words[_ranges(begin, size)] = ids
    words[begin + size] = len(numbers.dictionary) + np.arange(len(size))  # ends no match goes beyond
    first, last = repeated_windows(longest_matches(words, int(size.max())), begin, size, n)
    twice = counts > 1  # the same words several times in one block
    first, last = np.where(twice, begin, first), np.where(twice, begin + size - n, last)
    places, out, row = [X.unpack_planes(x).astype(np.int64) for x in pdf["places"]], [], 0
    for block, own, at in zip(pdf["block"], per_row, places, strict=True):
        mine = slice(row, row + len(own))
        row += len(own)
        hit = np.repeat(last[mine] >= first[mine], counts[mine])
        low, high = np.repeat(first[mine] - begin[mine], counts[mine])[hit], np.repeat(last[mine] - begin[mine], counts[mine])[hit]
        if hit.any():
            out.append((block, X.pack_planes(at[hit] + low), X.pack_planes(high - low + n)))
    return pd.DataFrame(out, columns=["block", "starts", "sizes"])


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """rows(id, text) to one row a block (block, ids, texts), the blocks being stretches of a scan's partitions."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        serial, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string()))], ["block", "ids", "texts"])
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= block_bytes:
                    yield pack()
                    serial, ids, texts, size = serial + 1, [], [], 0
        if ids:
            yield pack()

    return rows.mapInArrow(run, "block long, ids array<string>, texts array<string>")


def repeated_passages(docs: DataFrame, n: int = WINDOW, text: str = "text", order: str = "doc_id", block_bytes: int = X.BLOCK_BYTES, bits: int = 64, hot: int = HOT) -> DataFrame:
    """One row for each input row: order, n_words, n_removed, spans ([start, stop) word positions of the
    passages found), text (the words kept, joined by one space).

    A passage is a maximal run of words covered by windows of n words that also start anywhere else,
    in the same document or another, repeated rows included. A null text has no words; a text of fewer
    than n words has no window; a very long text is a block of its own, whole; an empty table gives an
    empty result; other columns of docs play no part.

    The corpus is cut into stretches of windows that share an anchor, and the stretches are dealt over
    reference blocks by anchor, so that all places where a window may occur are in one block. Anchors
    that occur once are sorted out first. Each block sorts the suffixes of its stretches and factors
    every stretch greedily against all others. The windows of anchors with more than `hot` stretches are
    dealt one by one, by their own words. Neither `bits` (of the word hashes) nor `hot` changes results.
    """
    rows = docs.select(F.col(order).cast("string").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(100_000, max(32, math.ceil(2 * size / block_bytes)))
    parts = max(X.LEAST_PARTS, math.ceil(size / 110 / PART_STRETCHES))  # about 110 bytes from anchor to anchor
    tasks = min(parts, 100_000)
    blocks = bucketed(_blocks(rows, block_bytes), buckets, "block")

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts = np.unique(Stretches(texts.as_py(), n, bits).key, return_counts=True)
                runs = list(X.runs(X.part_of(keys, parts)))
                cells = [[block] * len(runs), [p for p, _, _ in runs], [X.pack_keys(keys[a:b]) for _, a, b in runs], [X.pack(np.minimum(counts[a:b], 255).astype(np.uint8)) for _, a, b in runs]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["block", "part", "keys", "counts"])

    def recurs(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [X.unpack_keys(x) for x in pdf["keys"]]
        _, where = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(where, np.concatenate([X.unpack(x, np.uint8) for x in pdf["counts"]]))[where]
        verdict = np.where(total > hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "said": [X.pack(v) for v in np.split(verdict, np.cumsum([len(k) for k in asked])[:-1])]})

    def send(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, texts in zip(mine["block"], mine["texts"], strict=True):
            s = Stretches(list(texts), n, bits)
            own = answers[answers["block"] == block].sort_values("part")
            said = np.concatenate([np.zeros(0, np.uint8), *(X.unpack(x, np.uint8) for x in own["said"])])
            begin, end, route = s.asked(said[np.unique(s.key, return_inverse=True)[1]])
            if not len(begin):
                continue
            first = s.distinct(begin, end)
            part = X.part_of(X.mix(route), parts)[first]  # that of the first, so that all of the same words go together
            sort = np.lexsort((first, part))
            for p, a, b in X.runs(part[sort]):
                here = sort[a:b]
                lead, counts = np.unique(first[here], return_counts=True)
                used, local = np.unique(s.ids[_ranges(begin[lead], (end - begin)[lead])], return_inverse=True)
                words = zlib.compress(b" ".join(s.vocabulary.take(used).to_pylist()), 1)
                out.append((block, p, words, X.pack_planes(local), X.pack_planes((end - begin)[lead]), X.pack_planes(counts), X.pack_planes(begin[here])))
        return pd.DataFrame(out, columns=["block", "part", "vocabulary", "ids", "sizes", "counts", "places"])

    def resolve(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, ids, texts in zip(mine["block"], mine["ids"], mine["texts"], strict=True):
            words = _split(list(texts))
            ends = np.cumsum([len(w) for w in words])
            edge = np.zeros(int(ends[-1]) + 1, np.int32)
            for r in found[found["block"] == block].itertuples():
                starts = X.unpack_planes(r.starts).astype(np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + X.unpack_planes(r.sizes), -1)
            covered = np.cumsum(edge[:-1]) > 0
            for i, w, own in zip(ids, words, np.split(covered, ends[:-1]), strict=True):
                turn = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                kept = w if not spans else [x for x, c in zip(w, own, strict=True) if not c]
                out.append((i, len(w), len(w) - len(kept), spans, b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "spans", "text"])

    asked = blocks.select("block", "texts").mapInArrow(ask, "block long, part int, keys binary, counts binary")
    said = asked.repartition(tasks, "part").groupBy("part").applyInPandas(recurs, "block long, part int, said binary")
    sent = blocks.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(
        send, "block long, part int, vocabulary binary, ids binary, sizes binary, counts binary, places binary"
    )
    found = sent.repartition(tasks, "part").groupBy("part").applyInPandas(lambda pdf: _parsed(pdf, n), "block long, starts binary, sizes binary")
    out = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
        resolve, "id string, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, text string"
    )
    return out.select(F.col("id").cast(docs.schema[order].dataType).alias(order), "n_words", "n_removed", "spans", F.col("text").alias(text))
