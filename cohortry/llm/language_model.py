"""A Katz backoff model of word pairs: counted, normalised and applied in a few packed exchanges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import bucketed, cut

#: Counts up to this one are discounted.
DISCOUNTED = 5
#: UTF-8 bytes of text a block holds about.
BLOCK_BYTES = 12 << 20
#: The end of a text as a word, and the start of a text as a context.
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0xFFFFFFFF)
_TWO32 = np.uint64(32)


def good_turing(n: list[int], most: int = DISCOUNTED) -> np.ndarray:
    """Factors d[r] for counts r, from n[r] types seen r times (n[0] unused): Katz's choice for r up to
    the largest k for which all estimates make sense, and 1 beyond. If there is none: 1 - 1/(2r)."""
    for k in range(most, 0, -1):
        if min(n[1 : k + 2]) <= 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([0.0, *d, *[1.0] * (most - k), 1.0])
    return np.array([0.0, *[1 - 0.5 / r for r in range(1, most + 1)], 1.0])


def kept_mass(counts_of_small: np.ndarray, total, factors: np.ndarray):
    """What the factors leave of `total` counts; counts_of_small[..., r - 1] types were seen r times."""
    r = np.arange(1, DISCOUNTED + 1)
    return total - (counts_of_small * (r * (1 - factors[1:-1]))).sum(-1)


class Unigrams:
    """P(w): discounted counts over known words; the rest is shared by the unseen words there may be."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.factors = total, types, good_turing(n)
        kept = float(kept_mass(np.array(n[1 : DISCOUNTED + 1], float), float(total), self.factors))
        if total and kept >= total:  # nothing was discounted: leave the room of one token
            self.scale, left = 1 / (total + 1), 1 / (total + 1)
        else:
            self.scale, left = 1 / max(total, 1), 1 - kept / max(total, 1)
        # Chao's estimate of the number of unseen words.
        self.unseen = left / max(1.0, n[1] ** 2 / (2 * max(n[2], 1)))

    def of(self, counts: np.ndarray) -> np.ndarray:
        d = self.factors[np.minimum(counts, DISCOUNTED + 1)]
        return np.where(counts > 0, d * counts * self.scale, self.unseen)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs(id, held, text) to one row a block: its documents, its distinct word keys with their training
    counts, and its tokens as positions among these keys. Blocks are stretches of a scan's partitions."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        hashes, serial, base = X.WordHashes(), 0, TaskContext.get().partitionId() << 24
        ids, held, tokens, size = [], [], [], 0

        def block():
            flat = np.concatenate(tokens)
            keys, where = np.unique(flat, return_inverse=True)
            sizes = np.array([len(t) for t in tokens], np.int32)
            learn = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(where[learn], minlength=len(keys)).astype(np.int32)
            cells = [[base + serial], [ids], [held], [sizes.tolist()], [X.pack_keys(keys)], [X.pack_planes(counts)], [X.pack_planes(where)]]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds, strict=True)], ["block", "ids", "held", "sizes", "keys", "counts", "tokens"])

        for batch in batches:
            for i, h, t in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = raw.lower().split()  # bytes: A-Z only, and the six white-space characters
                ids.append(i)
                held.append(h)
                tokens.append(np.append(hashes.of(words), END))
                size += len(raw)
                if size >= block_bytes:
                    yield block()
                    serial, ids, held, tokens, size = serial + 1, [], [], [], 0
        if ids:
            yield block()

    schema = "block long, ids array<string>, held array<boolean>, sizes array<int>, keys binary, counts binary, tokens binary"
    return docs.mapInArrow(run, schema)


def _ask_words(parts: int):
    def run(batches):
        for batch in batches:
            for block, packed, counts in zip(batch["block"], batch["keys"], batch["counts"], strict=True):
                keys, learned = X.unpack_keys(packed), X.unpack_planes(counts)
                rows = [(block, p, X.pack_keys(keys[a:b]), X.pack_planes(learned[a:b])) for p, a, b in X.runs(X.part_of(keys, parts))]
                yield pd.DataFrame(rows, columns=["block", "part", "keys", "counts"])

    return run


def _answer_words(parts: int):
    """Counts and numbers of the words of one part; a word's number is small if it is frequent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, part = [X.unpack_keys(x) for x in pdf["keys"]], int(pdf["part"].iloc[0])
        keys, where = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(where, np.concatenate([X.unpack_planes(x) for x in pdf["counts"]]), len(keys)).astype(np.int64)
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
        if len(keys) and (int(rank.max()) + 1) * parts >= int(START):
            raise ValueError("more than four billion words: raise the number width")
        cuts = np.cumsum([len(k) for k in asked])[:-1]
        stats = [int(counts.sum()), int((counts > 0).sum()), *np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2].tolist()]
        return pd.DataFrame({
            "block": pdf["block"], "part": pdf["part"], "kind": 1, "a": [X.pack(x) for x in np.split(counts[where], cuts)],
            "b": [X.pack_planes(x) for x in np.split(rank[where], cuts)], "c": None, "d": None, "stats": [stats] + [None] * (len(pdf) - 1),
        })

    return run


ANSWER = "block long, part int, kind int, a binary, b binary, c binary, d binary, stats array<long>"


def _pairs_of(block: pd.Series, answers: pd.DataFrame, parts: int, share: float) -> dict:
    """The tokens of a block with counts and numbers, and its distinct pairs (context << 32 | word) and
    their contexts by part. Each part that holds pairs of a context is asked for its sums."""
    known = answers[answers["kind"] == 1].sort_values("part")
    counts = np.concatenate([X.unpack(x, np.int64) for x in known["a"]])
    ranks = [X.unpack_planes(x).astype(np.uint64) * np.uint64(parts) + np.uint64(p) for x, p in zip(known["b"], known["part"], strict=True)]
    numbers, tokens = np.concatenate(ranks), X.unpack_planes(block["tokens"])
    sizes = np.asarray(block["sizes"], np.int64)
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(sizes) - sizes] = True
    before = np.concatenate([tokens[:1], tokens[:-1]])
    c = counts[tokens]
    context = np.where(first, START, numbers[before])
    asks = first | (counts[before] > 0)  # also for unknown words: their context's backoff weight is needed
    pairs, where = np.unique(context[asks] << _TWO32 | numbers[tokens][asks], return_inverse=True)
    learn = np.repeat(~np.asarray(block["held"], bool), sizes)
    at = np.zeros(len(pairs), np.int64)
    at[where] = np.flatnonzero(asks)
    ends = counts[tokens[np.cumsum(sizes)[-1] - 1]]  # each training text has one end, and one start
    heads, head_of = np.unique(pairs >> _TWO32, return_inverse=True)
    often = np.zeros(len(heads), np.int64)
    often[head_of] = np.where(first[at], ends, counts[before[at]])
    # A context with more tokens than an average part is dealt over as many parts as it fills, by pair.
    spread = np.ceil(often / share).astype(np.uint64).clip(1, None)
    part = X.part_of(_place(heads[head_of], X.mix(pairs) % spread[head_of]), parts)
    wide = spread > 1
    copies = spread[wide].astype(np.int64)
    serial = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    wide_heads = np.repeat(heads[wide], copies)
    wide_parts = X.part_of(_place(wide_heads, serial.astype(np.uint64)), parts)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    by_part = []
    for p in np.unique(np.concatenate([part, wide_parts])).tolist():
        a, b = int(bounds[p]), int(bounds[p + 1])
        own = pairs[order[a:b]] >> _TWO32
        asked = np.unique(np.concatenate([own, wide_heads[wide_parts == p]]))
        by_part.append((p, order[a:b], asked, np.bincount(np.searchsorted(asked, own), minlength=len(asked))))
    return {
        "c": c, "asks": asks, "where": where, "pairs": pairs, "word_counts": c[at], "by_part": by_part, "sizes": sizes,
        "learned": np.bincount(where[learn[asks]], minlength=len(pairs)), "context": context,
    }


def _place(heads: np.ndarray, serial: np.ndarray) -> np.ndarray:
    return X.mix(X.mix(heads) + serial)


def _ask_pairs(parts: int, share: float):
    def run(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, block in mine.iterrows():
            x = _pairs_of(block, answers[answers["block"] == block["block"]], parts, share)
            for p, at, heads, sizes in x["by_part"]:
                rows.append((
                    block["block"], p, X.pack_keys(heads), X.pack_planes(sizes), X.pack_planes(x["pairs"][at] & START),
                    X.pack_planes(x["word_counts"][at]), X.pack_planes(x["learned"][at]),
                ))
        return pd.DataFrame(rows, columns=["block", "part", "heads", "sizes", "words", "word_counts", "learned"])

    return run


def _answer_pairs(unigrams: Unigrams):
    """Pair counts of one part; for each context the pairs by small count, all counts and the sum of P(w) of its words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, sizes = [X.unpack_keys(x) for x in pdf["heads"]], [X.unpack_planes(x) for x in pdf["sizes"]]
        asked = [np.repeat(h, s) << _TWO32 | X.unpack_planes(w).astype(np.uint64) for h, s, w in zip(heads, sizes, pdf["words"], strict=True)]
        pairs, at, where = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        learned = np.concatenate([X.unpack_planes(x) for x in pdf["learned"]])
        counts = np.bincount(where, learned, len(pairs)).astype(np.int64)
        p = np.where(counts > 0, unigrams.of(np.concatenate([X.unpack_planes(x) for x in pdf["word_counts"]])[at].astype(np.int64)), 0.0)
        every = np.unique(np.concatenate(heads))
        head = np.searchsorted(every, pairs >> _TWO32)
        small = np.stack([np.bincount(head[counts == r], minlength=len(every)) for r in range(1, DISCOUNTED + 1)], 1).astype(np.int32)
        total, mass = np.bincount(head, counts, len(every)).astype(np.int64), np.bincount(head, p, len(every))
        cuts = np.cumsum([len(k) for k in asked])[:-1]
        mine = [np.searchsorted(every, h) for h in heads]
        stats = [0, 0, *np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2].tolist()]
        return pd.DataFrame({
            "block": pdf["block"], "part": pdf["part"], "kind": 2, "a": [X.pack_planes(x) for x in np.split(counts[where], cuts)],
            "b": [X.pack(mass[i]) for i in mine], "c": [X.pack(small[i].T) for i in mine], "d": [X.pack(total[i]) for i in mine],
            "stats": [stats] + [None] * (len(pdf) - 1),
        })

    return run


def _score(parts: int, share: float, unigrams: Unigrams, factors: np.ndarray):
    def run(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in mine.iterrows():
            own = answers[answers["block"] == block["block"]]
            x = _pairs_of(block, own, parts, share)
            said = {r.part: r for r in own[own["kind"] == 2].itertuples()}
            counts, heads, small, total, mass = np.zeros(len(x["pairs"]), np.int64), [], [], [], []
            for p, at, asked, _ in x["by_part"]:
                r = said[p]
                counts[at] = X.unpack_planes(r.a)
                heads.append(asked)
                mass.append(X.unpack(r.b, np.float64))
                small.append(X.unpack(r.c, np.int32).reshape(DISCOUNTED, -1).T)
                total.append(X.unpack(r.d, np.int64))
            # A frequent context has answers from several parts.
            every, where = np.unique(np.concatenate([*heads, np.zeros(0, np.uint64)]), return_inverse=True)
            total = np.bincount(where, np.concatenate([*total, np.zeros(0)]), len(every))
            mass = np.bincount(where, np.concatenate([*mass, np.zeros(0)]), len(every))
            few = np.zeros((len(every), DISCOUNTED))
            if len(every):
                np.add.at(few, where, np.concatenate(small))
            kept = kept_mass(few, total, factors)
            full = kept >= total  # no count of the context was discounted: leave the room of one token
            scale = 1 / np.where(full, total + 1, np.maximum(total, 1))
            alpha = np.where(full, scale, 1 - kept * scale) / np.maximum(1 - mass, 1e-300)

            low = unigrams.of(x["c"])
            prob = low.copy()  # an unknown context backs off in full
            here = np.searchsorted(every, x["context"])
            here[here == len(every)] = 0
            known = (every[here] == x["context"]) & (total[here] > 0) if len(every) else np.zeros(len(low), bool)
            prob[known] = alpha[here[known]] * low[known]
            r = np.zeros(len(low), np.int64)
            r[x["asks"]] = counts[x["where"]]
            seen = known & (r > 0)
            prob[seen] = factors[np.minimum(r[seen], DISCOUNTED + 1)] * r[seen] * scale[here[seen]]

            sizes = x["sizes"]
            starts = np.cumsum(sizes) - sizes
            base = np.log10((x["c"] + 1) / (unigrams.total + unigrams.types + 1))
            out.append(pd.DataFrame({
                "id": list(block["ids"]), "held_out": list(block["held"]), "n_tokens": sizes, "n_known": np.add.reduceat((x["c"] > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(prob), starts),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _stats(answers: DataFrame) -> list[int]:
    at = [F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(DISCOUNTED + 3)]
    return list(answers.agg(*at).first())


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", order: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each input row: order, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z lower-cased, and one end. The model learns from the rows where
    held_out is false (a null counts as false) and gives each token its probability after the token
    before it, or after the start of the text: a seen pair its discounted share of the context's pairs,
    any other word the context's backoff weight times the word's own probability. The weights make the
    probabilities of all words after a context sum to one, those of the words never seen included.

    A null text is empty and has one token; repeated rows count as often as they occur; an empty table
    gives an empty result.

    Three packed exchanges do the work: blocks of documents ask for the counts of their words, then for
    the counts of their pairs and the sums of their contexts; the counts stay in checkpointed tables
    partitioned by key. The blocks are bucketed Parquet in the shared folder, which all three read.
    """
    rows = docs.select(F.col(order).cast("string").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = X.layout_parts(size)
    buckets = max(32, -(-size // block_bytes) * 2)
    tasks = min(parts, 100_000)
    blocks = bucketed(_blocks(rows, block_bytes), int(min(buckets, 100_000)), "block")
    words = blocks.select("block", "keys", "counts").mapInPandas(_ask_words(parts), "block long, part int, keys binary, counts binary")
    word_answers = cut(words.repartition(tasks, "part").groupBy("part").applyInPandas(_answer_words(parts), ANSWER))
    total, types, *n = _stats(word_answers)
    unigrams, share = Unigrams(total, types, [0, *n]), max(1000.0, total / parts)

    pairs = blocks.groupBy("block").cogroup(word_answers.groupBy("block")).applyInPandas(
        _ask_pairs(parts, share), "block long, part int, heads binary, sizes binary, words binary, word_counts binary, learned binary"
    )
    pair_answers = cut(pairs.repartition(tasks, "part").groupBy("part").applyInPandas(_answer_pairs(unigrams), ANSWER))
    _, _, *n = _stats(pair_answers)
    answers = word_answers.unionByName(pair_answers)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score(parts, share, unigrams, good_turing([0, *n])), "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    out = scored.select(
        F.col("id").cast(docs.schema[order].dataType).alias(order), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"
    )
    return out
