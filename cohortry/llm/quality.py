"""Document quality by hierarchical empirical Bayes over sites and their paths."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import cut, maybe_broadcast

#: Labelled rows a classifier learns from at most, the smallest by a hash of their id.
TRAINING_ROWS = 12_000
#: Weights of a classifier: hashed words and bins of the text's shape.
WIDTH = 1 << 18
_SHAPE_BINS = 12
SHAPES = WIDTH - 6 * (_SHAPE_BINS + 1)
WORD = r"[0-9a-z\x80-\U0010FFFF]+"


def _shape(text: str) -> list[float]:
    """Shares from 0 to 1: capitals among letters, symbols, digits and bars among characters, repeated lines, distinct words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return [0.0] * 6
    upper = ((codes >= 65) & (codes <= 90)).sum()
    letters = upper + ((codes >= 97) & (codes <= 122)).sum() + (codes > 127).sum()
    digits = ((codes >= 48) & (codes <= 57)).sum()
    spaces = ((codes == 32) | ((codes >= 9) & (codes <= 13))).sum()
    lines, words = text.split("\n"), text.split()
    return [
        upper / max(1, letters), (len(codes) - letters - digits - spaces) / len(codes), digits / len(codes), (codes == 124).sum() / len(codes),
        1 - len(set(lines)) / len(lines), len(set(words)) / max(1, len(words)),
    ]


def features(text: str, hashes: X.WordHashes, find=re.compile(WORD).findall) -> np.ndarray:
    """Places of the weights that a text has: one for each distinct word, one bin for each shape."""
    words = hashes.of(list(set(find(text.lower())))) % np.uint64(SHAPES)
    bins = [SHAPES + i * (_SHAPE_BINS + 1) + min(_SHAPE_BINS, round(_SHAPE_BINS * float(x) ** 0.5)) for i, x in enumerate(_shape(text))]
    return np.unique(np.concatenate([words.astype(np.int64), np.array(bins, np.int64)]))


def fit(rows: list[tuple[np.ndarray, int]], steps: int = 300, penalty: float = 1e-3, least_z: float = 4.5) -> dict:
    """Logistic regression by full-gradient steps with a rate of its own for each weight; the classes weigh
    alike. Of the words only those count whose shares in the two classes differ by least_z standard errors."""
    weights, bias = np.zeros(WIDTH), 0.0
    y = np.array([r[1] for r in rows], float)
    positive = float(y.mean()) if len(y) else 0.5
    if not len(rows) or not 0 < positive < 1:  # one class only: no evidence
        return {"weights": weights.astype(np.float32), "bias": 0.0, "prior": min(max(positive, 0.01), 0.99)}
    at = np.concatenate([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    ones, zeros = y.sum(), len(y) - y.sum()
    held, held_ones = np.bincount(at, minlength=WIDTH), np.bincount(at, y[owner], WIDTH)
    share = held / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / zeros))
    telling = np.abs(held_ones / ones - (held - held_ones) / zeros) >= least_z * error
    telling[held < 3] = False
    telling[SHAPES:] = True
    at, owner = at[telling[at]], owner[telling[at]]
    mass = np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive)) / len(y)
    square, square_bias = np.full(WIDTH, 1e-10), 1e-10
    for _ in range(steps):
        z = bias + np.bincount(owner, weights[at], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * mass
        slope = np.bincount(at, error[owner], WIDTH) + penalty * weights * telling / WIDTH**0.5
        square += slope * slope
        square_bias += error.sum() ** 2
        weights -= 0.3 * slope / np.sqrt(square)
        bias -= 0.3 * error.sum() / np.sqrt(square_bias)
    return {"weights": weights.astype(np.float32), "bias": bias, "prior": positive}


def train(docs: DataFrame, labels: DataFrame, names: list[str], text: str, order: str, most: int = TRAINING_ROWS) -> dict[str, dict]:
    """A classifier for each label column, from at most `most` labelled rows. Of documents that share an id the largest text counts."""
    chosen = labels.select(F.col(order).alias("id"), *names).where(F.col(order).isNotNull()).orderBy(F.xxhash64("id"), *names).limit(most)
    texts = docs.select(F.col(order).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen.select("id").distinct()), "id")
    sample = texts.groupBy("id").agg(F.max("t").alias("t")).join(F.broadcast(chosen), "id").select("t", *names)

    def run(batches):
        import pyarrow as pa

        hashes = X.WordHashes()
        for batch in batches:
            found = [features(t, hashes).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], ["f", *names])

    kinds = ", ".join(f"`{n}` {sample.schema[n].dataType.simpleString()}" for n in names)
    rows = sample.mapInArrow(run, f"f array<int>, {kinds}").collect()  # at most `most` rows: a text for each chosen label row
    return {n: fit([(np.array(r["f"]), int(r[n])) for r in rows if r[n] is not None]) for n in names}


def evidence(docs: DataFrame, models: dict[str, dict], text: str) -> DataFrame:
    """docs without text, with llr_<label>: the classifier's log odds with both classes alike."""
    kept, shared = [c for c in docs.columns if c != text], docs.sparkSession.sparkContext.broadcast(models)
    names = list(models)
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"llr_{n} double" for n in names)])

    def run(batches):
        import pyarrow as pa

        hashes = X.WordHashes()
        for batch in batches:
            found = [features(t or "", hashes) for t in batch.column(0).to_pylist()]
            out = []
            for n in names:
                m = shared.value[n]
                out.append(pa.array([float(m["bias"] + m["weights"][f].sum(dtype=np.float64)) for f in found], pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], [*kept, *(f"llr_{n}" for n in names)])

    return docs.select(text, *kept).mapInArrow(run, fields)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, parent: list[str]) -> float:
    """How many documents a parent's rate is worth, by moments around the parents' own rates: groups(n, s and
    parent) are n documents whose probabilities sum to s. Groups that differ no more than chance makes
    them give a strong parent."""
    n, s = F.col("n"), F.col("s")
    by = groups.where("n >= 2").groupBy(*parent).agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.count("*").alias("k"), F.sum(s * s / n).alias("q"), F.sum(n * n).alias("nn"))
    r = by.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col("k") - 1).alias("free"), F.sum(F.col("q") - s * s / n).alias("q"), F.sum(n - F.col("nn") / n).alias("room")).first()
    if (r["free"] or 0) <= 0:
        return 100.0
    mean = r["s"] / r["n"]
    noise = max(mean * (1 - mean), 1e-9)
    between = max(r["q"] - r["free"] * noise, 0.0) / max(r["room"], 1.0)
    return min(max(noise / between - 1 if between > 0 else 1e4, 1.0), 1e4)


def quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, names: list[str], text: str = "text", order: str = "doc_id", most: int = TRAINING_ROWS
) -> DataFrame:
    """One row for each input row: order, host, path, and for each label p_<label>, its posterior probability.

    A classifier learned from labels gives each document its evidence. A host's rate is shrunk toward the
    rate of all documents, a path's toward its host's, each by a strength estimated from how much such
    groups differ; a document's prior is its path's rate without the document's own part. A null text
    counts as empty, a long one is read whole, a null host or path counts as a group of its own; repeated rows count as often as they
    occur; without labels of both classes there is no evidence and only priors remain; an empty table
    gives an empty result.
    """
    models = train(docs, labels, names, text, order, most)
    rows = docs.select(F.col(order).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), text)
    scored = cut(evidence(rows, models, text))
    for n in names:
        prior = models[n]["prior"]
        scored = scored.withColumn(f"s_{n}", _sigmoid(F.col(f"llr_{n}") + float(np.log(prior / (1 - prior)))))
    # Partial sums are combined in each task, so a large host costs one row a task.
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"s_{n}").alias(f"s_{n}") for n in names]))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{n}").alias(f"hs_{n}") for n in names])
    total = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"hs_{n}").alias(n) for n in names]).first()
    shrunk = paths.join(maybe_broadcast(hosts, 100), "host")
    for n in names:
        rate = (total[n] + 1.0 * models[n]["prior"]) / (total["n"] + 1.0) if total["n"] else models[n]["prior"]
        kh = _strength(hosts.select(F.col("hn").alias("n"), F.col(f"hs_{n}").alias("s")), [])
        kp = _strength(paths.select("n", F.col(f"s_{n}").alias("s"), "host"), ["host"])
        shrunk = shrunk.withColumn(f"h_{n}", (F.col(f"hs_{n}") + kh * rate) / (F.col("hn") + kh)).withColumn(f"k_{n}", F.lit(kp))
    known = shrunk.select("host", "path", "n", *[F.col(f"s_{n}").alias(f"ps_{n}") for n in names], *[f"h_{n}" for n in names], *[f"k_{n}" for n in names])
    joined = scored.join(maybe_broadcast(known, 200), ["host", "path"])
    out = [F.col("id").alias(order), "host", "path"]
    for n in names:
        without = (F.col(f"ps_{n}") - F.col(f"s_{n}") + F.col(f"k_{n}") * F.col(f"h_{n}")) / (F.col("n") - 1 + F.col(f"k_{n}"))
        out.append(_sigmoid(F.col(f"llr_{n}") + _logit(F.least(F.greatest(without, F.lit(1e-6)), F.lit(1 - 1e-6)))).alias(f"p_{n}"))
    return joined.select(*out)
