"""Near-duplicates by Order MinHash and banded alignment."""

from __future__ import annotations

import re
from math import ceil
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .common import cut, few_rows_a_batch, forget, fresh, maybe_broadcast, shuffles_removed, written
from .components import components

#: Words in a k-mer, k-mers kept in text order by one sketch, sketches of a text.
K, ELL, SKETCHES = 5, 2, 24
SIMILARITY = 0.8
#: The words of a text: runs of digits, letters a-z and all beyond ASCII, once lower-cased.
WORD = r"[0-9a-z\x80-\U0010FFFF]+"
#: Bins of a text's histogram of words; members of a bucket that one cell holds about.
BINS, CHUNK = 512, 512
#: Hash values of a long text in memory at once; rows an alignment takes between moves of its window.
AT_ONCE, ROWS = 1 << 19, 1024


def words_of(text: str | None, find=re.compile(WORD).findall) -> list[str]:
    return find((text or "").lower())


def labelled_kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words and of how often it occurred before; of all words if fewer."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    total = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        total = X.mix(total + hashes[i : i + len(total)])
    order = np.argsort(total, kind="stable")
    ordered = total[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(len(ordered))
    seen = np.empty(len(ordered), np.uint64)
    seen[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return X.mix(total + seen * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(kmers: np.ndarray, sketches: int, ell: int) -> np.ndarray:
    """Each sketch: the ell k-mers with the smallest values of its hash function, in text order, as one number."""
    seeds = X.mix(np.arange(1, sketches + 1, dtype=np.uint64))
    group = max(1, AT_ONCE // max(1, len(kmers)))
    return np.concatenate([_sketches_by(seeds[i : i + group], kmers, ell) for i in range(0, sketches, group)])


def _sketches_by(seeds: np.ndarray, kmers: np.ndarray, ell: int) -> np.ndarray:
    values = (kmers[None, :] ^ seeds[:, None]) * (seeds[:, None] | np.uint64(1))
    values ^= values >> np.uint64(32)
    if len(kmers) > ell:
        places = np.sort(np.argpartition(values, ell - 1, axis=1)[:, :ell], axis=1)
    else:
        places = np.tile(np.arange(len(kmers)), (len(seeds), 1))
    out = seeds.copy()
    for i in range(places.shape[1]):
        out = X.mix(out + kmers[places[:, i]])
    return out


def bucket_keys(kmers: np.ndarray, sketches: int, ell: int) -> np.ndarray:
    """Each sketch is a bucket, and so is each sketch with the next one: the second kind is more specific."""
    own = order_sketches(kmers, sketches, ell)
    return np.concatenate([own, X.mix(own + X.mix(np.roll(own, -1) + np.uint64(7)))]).astype(np.int64)


def word_bins(hashes: np.ndarray) -> bytes:
    """Four bytes of a step, then a byte a bin: the words whose hash falls into the bin, in steps, rounded up."""
    counts = np.bincount((hashes & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    step = max(1, -(-int(counts.max()) // 255))
    return step.to_bytes(4, "little") + (-(-counts // step)).astype(np.uint8).tobytes()


def unpacked_bins(data: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), 4 + BINS)
    steps = np.ascontiguousarray(raw[:, :4]).view("<u4").astype(np.int32)
    return raw[:, 4:] if (steps == 1).all() else raw[:, 4:].astype(np.int32) * steps


class Members(NamedTuple):
    """Members of a bucket: node, n words, class label, whether outside the bucket's largest class, bins, sketches."""

    node: np.ndarray
    n: np.ndarray
    label: np.ndarray
    out: np.ndarray
    bins: np.ndarray
    held: np.ndarray

    def at(self, places: np.ndarray) -> Members:
        return Members(*[x[places] for x in self])


def open_pairs(left: Members, right: Members, key: int, least: float, best: int | None):
    """(node of left, nodes of right) with different labels that may be similar and whose first shared sketch is
    key: other buckets leave the pair to that one. left are outside the largest class; two such members are
    paired in the order of their nodes only. Matched words are in both texts, so no more than the sum of the
    smaller bins. If best is given, each of left names only so many that it may be most similar to."""
    right = right.at(np.argsort(right.n, kind="stable"))
    low = np.searchsorted(right.n, left.n * least * (1 - 1e-9))
    high = np.searchsorted(right.n, left.n / least * (1 + 1e-9), side="right")
    for i in range(len(left.n)):
        j = np.arange(low[i], high[i])
        j = j[(right.label[j] != left.label[i]) & (~right.out[j] | (right.node[j] > left.node[i]))]
        longer = np.maximum(right.n[j], left.n[i])
        j = j[np.minimum(right.n[j], left.n[i]) >= least * longer]
        if len(j):
            j = j[left.held[i][(left.held[i] == right.held[j]).argmax(axis=1)] == key]
        if len(j):
            common = np.minimum(left.bins[i], right.bins[j]).sum(axis=1, dtype=np.int32)
            share = common / np.maximum(right.n[j], left.n[i])
            may = share >= least - 1e-9
            j, share = j[may], share[may]
            if best is not None and len(j) > best:
                j = j[np.argpartition(-share, best)[:best]]
        if len(j):
            yield left.node[i], right.node[j]


def banded_matches(a: list, b: list, band: int) -> int:
    """Words of a and b that an alignment within the band can match: a longest common subsequence of
    words whose positions differ by band at most, by bits of the columns in the band's window."""
    shorter = min(len(a), len(b))
    low_end = next((i for i in range(shorter) if a[i] != b[i]), shorter)
    high_end = next((i for i in range(shorter - low_end) if a[-1 - i] != b[-1 - i]), shorter - low_end)
    a, b = a[low_end : len(a) - high_end], b[low_end : len(b) - high_end]
    matched = base = width = row = 0  # row: a bit for each column of the window from base on, 0 if it is matched
    rows = max(ROWS, band)
    for start in range(0, len(a), rows):
        first, last = max(0, start - band), min(len(b), start + rows + band)
        if first >= len(b):
            break
        row |= (1 << last - base) - (1 << width)  # columns that come into reach
        width = last - base
        if first > base:  # columns out of reach of all rows to come
            gone = first - base
            matched += gone - (row & (1 << gone) - 1).bit_count()
            row, width, base = row >> gone, width - gone, first
        places: dict = {}
        for j, w in enumerate(b[base:last]):
            places.setdefault(w, []).append(j)
        # The few most frequent words have a mask of the window, others their places: memory stays in proportion to it.
        often, full, masks = 8 + width // 1024, (1 << width) - 1, {}
        for i in range(start, min(start + rows, len(a))):
            at = places.get(a[i])
            if at is None:
                continue
            low, high = i - band - base, i + band - base
            if len(at) > often:
                m = masks.get(a[i])
                if m is None:
                    m = masks[a[i]] = sum(1 << j for j in at)
                m = (m >> low << low if low > 0 else m) & (1 << high + 1) - 1
            else:
                m = sum(1 << j for j in at if low <= j <= high)
            u = row & m
            row = (row + u | row - u) & full
    return low_end + high_end + matched + width - row.bit_count()


def similarity(a: list, b: list, least: float = SIMILARITY) -> float:
    """Matched words over the words of the longer text; 0 if no alignment within the band can reach least."""
    longer = max(len(a), len(b))
    if not longer or min(len(a), len(b)) < least * longer:
        return 0.0
    return banded_matches(a, b, ceil((1 - least) * longer)) / longer


def _sketched(rows: DataFrame, k: int, ell: int, sketches: int) -> DataFrame:
    """rows(id, digest, text) to (id, digest, n, bins, keys)."""
    added = "n int, bins binary, keys array<long>"
    schema = T.StructType([*rows.select("id", "digest").schema.fields, *T.StructType.fromDDL(added).fields])

    def run(batches):
        import pyarrow as pa

        hashes = X.WordHashes()
        for batch in batches:
            keys, counts, bins = [], [], []
            for t in batch.column(2):  # one text at a time, not a batch of them
                words = words_of(t.as_py())
                counts.append(len(words))
                hashed = hashes.of(words)
                bins.append(word_bins(hashed))
                keys.append(bucket_keys(labelled_kmers(hashed, k), sketches, ell) if words else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(bins, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """pairs(a, b, ta, tb) that are similar, as (a, b, similarity)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [similarity(words_of(x.as_py()), words_of(y.as_py()), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array([s >= least for s in found])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(keep)

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def _linked(pairs: DataFrame, rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) of nodes whose texts are similar, as (a, b, similarity)."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = texts.select("node", "digest", "first").join(maybe_broadcast(used, 24), "node", "left_semi")
    held = rows.join(maybe_broadcast(wanted, 96), (rows["digest"] == wanted["digest"]) & rows["id"].eqNullSafe(wanted["first"]))
    # A table of its own: the joins then read plain exchanges, and a leader with many candidates can be split.
    contents = written(held.select("node", "text").dropDuplicates(["node"]))
    with_a = pairs.join(contents.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    with_both = with_a.join(contents.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    with few_rows_a_batch(pairs.sparkSession):
        links = cut(_verified(with_both, least))
    forget(contents)
    return links


def _open_pairs(rest: DataFrame, least: float, best: int | None) -> DataFrame:
    """The open pairs (a, b) of rest(key, m, most, top, node, n, label, bins, held): held are a text's sketches, m is
    the size of the bucket, most that of its largest class, top. Members outside that class meet all members,
    those within it don't meet one another: both sides of a large bucket are dealt over parts, and each two
    parts meet in a cell; small buckets share cells."""

    def run(cell):
        import pyarrow as pa

        key, i, j, left = (cell.column(c).to_numpy() for c in ("key", "i", "j", "left"))
        order = np.lexsort((left, j, i, key))
        key, i, j, left = key[order], i[order], j[order], left[order]
        columns = [cell.column(c).to_numpy(zero_copy_only=False)[order] for c in ("node", "n", "label", "out")]
        held = cell.column("held").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        all_ = Members(*columns, unpacked_bins(cell.column("bins").to_pylist())[order], held)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
            middle = s + int(np.searchsorted(left[s:e], True))
            for x, ys in open_pairs(all_.at(np.arange(middle, e)), all_.at(np.arange(s, middle)), key[s], least, best):
                a.append(np.full(len(ys), x))
                b.append(ys)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    cells = ceil(rest.count() / CHUNK)
    parts = lambda size: F.ceil(size / CHUNK).cast("int")
    rest = rest.withColumns({"out": F.col("label") != F.col("top"), "outs": parts(F.col("m") - F.col("most")), "alls": parts(F.col("m"))})
    part = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rest.withColumns({"i": every("outs"), "j": part(0, "alls"), "left": F.lit(False)})
    left = rest.where("out").withColumns({"i": part(1, "outs"), "j": every("alls"), "left": F.lit(True)})
    cell = F.when(F.col("alls") > 1, F.xxhash64("key", "i", "j")).otherwise(F.pmod(F.col("key"), F.lit(max(cells, 1))))
    dealt = right.unionByName(left).select(cell.alias("cell"), "key", "i", "j", "left", "node", "n", "label", "out", "bins", "held")
    return dealt.groupBy("cell").applyInArrow(run, "a long, b long").distinct()


def _smallest_id() -> Column:
    return F.min(F.struct(F.col("id").isNotNull().alias("known"), "id"))  # nulls first


def _labels(docs: DataFrame, text: str, order: str, k: int, ell: int, sketches: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The node of each row, (id, node), and the class of each node that a link joins to others, (node, label)."""
    rows = docs.select(F.col(order).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    with few_rows_a_batch(docs.sparkSession):
        sketched = written(_sketched(rows, k, ell, sketches))
    texts = sketched.groupBy("digest").agg(_smallest_id().alias("f"), F.min(F.struct("n", "bins", "keys")).alias("s"))
    texts = written(texts.select("digest", F.col("f.id").alias("first"), "s.*", F.monotonically_increasing_id().alias("node")))
    members = cut(sketched.select("id", "digest").join(texts.select("digest", "node"), "digest").select("id", "node"))
    forget(sketched)
    repeated = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select(F.col("id").alias("same"), "a")
    by_id = members.join(maybe_broadcast(repeated, 64), F.col("id").eqNullSafe(F.col("same"))).select("a", F.col("node").alias("b"))

    # The smallest id leads: it is the likelier source of the others.
    held = texts.select(F.struct(F.col("first").isNotNull().alias("known"), "first", "node", "n").alias("t"), F.explode("keys").alias("key"))
    leaders = held.groupBy("key").agg(F.min("t").alias("lead"), F.count("*").alias("held")).where("held > 1").select("key", "lead")
    near = F.least(F.col("n"), F.col("lead.n")) >= least * F.greatest(F.col("n"), F.col("lead.n"))
    held = texts.select("node", "n", F.explode("keys").alias("key"))
    led = held.join(leaders, "key").where((F.col("node") != F.col("lead.node")) & near)
    pairs = cut(led.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct())
    labels = components(_linked(pairs, rows, texts, least).select("a", "b").union(by_id))

    mixed = None
    for best in (8, None):
        labelled = texts.join(maybe_broadcast(labels, 40), "node", "left").withColumn("label", F.coalesce("label", "node"))
        # Pairs of neighbouring sketches meet in the buckets of each, too.
        own = F.slice("keys", 1, sketches)
        held = labelled.select("node", "n", "label", "bins", own.alias("held"), F.explode(own).alias("key"))
        if mixed is not None:
            held = held.join(maybe_broadcast(mixed.select("key"), 24), "key", "left_semi")
        classes = held.groupBy("key", "label").agg(F.count("*").alias("c"))
        sizes = classes.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("top"))
        mixed = cut(sizes.where("most < m"))
        rest = written(held.join(maybe_broadcast(mixed, 48), "key"), "zstd")
        more = cut(_open_pairs(rest, least, best).join(pairs, ["a", "b"], "left_anti"))
        forget(rest)
        found = _linked(more, rows, texts, least)
        pairs = pairs.union(more)
        for end in ("a", "b"):
            found = found.join(maybe_broadcast(labels, 40), F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("label", end)).select("a", "b")
        joined = components(found).select(F.col("node").alias("old"), F.col("label").alias("new"))
        known = labels.unionByName(joined.select(F.col("old").alias("node"), F.col("old").alias("label")).join(labels, "node", "left_anti"))
        labels = cut(known.join(maybe_broadcast(joined, 40), F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")))
    forget(texts)
    return members, labels


def near_duplicates(
    docs: DataFrame, text: str = "text", order: str = "doc_id", k: int = K, ell: int = ELL, sketches: int = SKETCHES, least: float = SIMILARITY
) -> DataFrame:
    """One row for each input row: order, class_id (the smallest id of its class), class_size, kept.

    A class holds the rows linked, directly or through others, by equal texts, by equal ids, or by texts of
    which an alignment matches at least the share `least` of the longer one's words. The row of class_id
    stays. Ids may be of any type that can be ordered; a null id counts as the smallest. A null text equals
    the empty one; a text without words is linked to equal texts only; an empty table gives an empty result.
    Long texts are compared whole, in memory and time of the band of their alignment.

    Equal texts are collapsed to a node first. In each bucket of equal sketches every node is first compared
    with that of the smallest id, which joins large classes by as many pairs as rows. Then all members of a
    bucket that are in different classes are compared, unless their lengths or words rule a link out: first
    with the few they have most words in common with, to join what a leader has not, then each pair that is
    left. So any two texts that share a sketch were compared, or cannot be linked, or share a class.
    """
    with shuffles_removed(docs.sparkSession):
        members, labels = _labels(docs, text, order, k, ell, sketches, least)
    said = members.join(maybe_broadcast(labels, 40), "node", "left").select("id", F.coalesce("label", "node").alias("label"))
    # Classes of several rows only; a table of its own, so that a join beyond the broadcast can split a large class.
    classes = cut(said.groupBy("label").agg(F.count("*").alias("class_size"), _smallest_id().alias("f")).where("class_size > 1").select("label", "class_size", F.col("f.id").alias("first")))
    said = said.join(maybe_broadcast(classes, 72), "label", "left")
    class_id = F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("first"))
    return said.select(F.col("id").alias(order), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("id").eqNullSafe(class_id).alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", order: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each class, the one with the smallest id; columns as they were.

    Rows that share an id share its fate; nulls, empty texts and empty tables as in near_duplicates.
    """
    name = fresh("__gone", docs.columns)
    gone = near_duplicates(docs, text, order, **how).where("not kept").select(F.col(order).alias(name))
    return docs.join(gone, F.col(order).eqNullSafe(F.col(name)), "left_anti")
