"""Mixtures against plain loops, the splitting tree and the permutations by their laws, and odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cohortry.llm import mixture
from cohortry.llm.mixture import dealt, mix, permuted, shard_texts, taken

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_tree_deals_exact_quotas_with_all_deals_equally_likely():
    quotas, rooms = np.array([5, 0, 13, 2]), np.array([4, 4, 4, 4, 4])
    sums, rounds = np.zeros((5, 4)), 4000
    for seed in range(rounds):
        got = dict(dealt(quotas, rooms, (seed,)))
        table = np.stack([got[i] for i in range(5)])
        assert (table.sum(axis=0) == quotas).all() and (table.sum(axis=1) == rooms).all() and (table >= 0).all()
        sums += table
    assert np.abs(sums / rounds - np.outer(rooms / 20, quotas)).max() < 0.06
    assert all((a[1] == b[1]).all() for a, b in zip(dealt(quotas, rooms, (1,)), dealt(quotas, rooms, (1,)), strict=True))


@pytest.mark.parametrize("size", [1, 2, 3, 100, 1000, 4097])
def test_permutation_of_block_numbers(size):
    numbers = np.arange(size)
    got = permuted(numbers, np.full(size, size), np.full(size, 5, np.uint64))
    assert sorted(got) == list(numbers) and (size < 100 or (got != numbers).mean() > 0.9)
    assert size < 100 or (got != permuted(numbers, np.full(size, size), np.full(size, 6, np.uint64))).any()


def plain(rows, weights=(1, 2, 3), most=3):
    """rows: (doc_id, source, text) to a list of (doc_id, size, source_size, target, taken)."""
    size = lambda t: len(WORD.findall(t or ""))
    whole = defaultdict(int)
    for _, s, t in rows:
        whole[s] += size(t)
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    weight, target, held = {s: weights[i % len(weights)] for i, s in enumerate(names)}, {}, set()
    while True:
        free = [s for s in names if s not in held]
        rest = sum(whole.values()) - sum(most * whole[s] for s in held)
        share = sum(weight[s] for s in free)
        target = {s: most * whole[s] if s in held else rest / share * weight[s] for s in names}
        over = {s for s in free if target[s] > most * whole[s]}
        if not over:
            break
        held |= over
    out = []
    for s in names:
        words, at = int(target[s] + 0.5), 0
        own = sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[2] or ''}".encode()).hexdigest())
        for i, _, t in own:
            line = [at + e * whole[s] for e in range(most)]
            out.append((i, size(t), whole[s], target[s], sum(max(0, min(words, x + size(t)) - x) for x in line)))
            at += size(t)
    return out


def invented(seed, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "b", "b", "b", "b", "b", "b", "Z", None, "é", "\U0001f600", "tiny"]
    rows = [(i, rng.choice(sources[:-1]), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 30])))) for i in range(n)]
    return rows + [(n, "tiny", "one two three"), (n + 1, "a", None), (n + 2, "a", " \t\n"), (7, "b", "same row twice"), (7, "b", "same row twice"), (None, "b", "no id"), (n + 3, "hollow", None), (n + 4, "b", "x " * 5000)]


@pytest.mark.parametrize("cell_rows", [3, 2000])
def test_equals_plain_loops(spark, cell_rows):
    rows = invented(1)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = [tuple(r) for r in taken(mix(df, block_words=64, cell_rows=cell_rows)).collect()]
    key = lambda r: (str(r[0]), r[1], r[4])
    want = sorted(plain(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12) and a[4] == b[4] <= 3 * b[1]


def test_shards_hold_disjoint_blocks_of_every_source(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SOURCES", 2)  # several groups of sources
    rows = invented(2)
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "doc_id long, source string, text string, uid int, rank string, size int")
    made = mix(df, block_words=50, shards=5)
    sources = {r["rank"]: r for r in made.sources.collect()}
    pieces = made.pieces.collect()
    held, shard_of = defaultdict(int), {}
    for p in pieces:
        held[p["rank"]] += p["stop"] - p["start"]
        assert shard_of.setdefault((p["rank"], p["block"]), p["shard"]) == p["shard"] and p["start"] < p["stop"]
    assert held == {k: s["words"] for k, s in sources.items() if s["words"]} and all(abs(s["words"] - s["target"]) <= 0.5 for s in sources.values())
    counts = [list(shard_of.values()).count(i) for i in range(5)]
    assert sum(counts) == sum(s["blocks"] for s in sources.values()) and max(counts) - min(counts) <= 1
    assert len({(p["uid"], p["epoch"], p["start"]) for p in pieces}) == len(pieces)
    texts = shard_texts(df, made).collect()
    assert sum(len(r["text"].split()) for r in texts) == sum(held.values()) and len(texts) == len(pieces)
    again = shard_texts(df.repartition(7), mix(df.repartition(7), block_words=50, shards=5)).collect()
    assert sorted(map(str, texts)) == sorted(map(str, again))


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [tuple(r)[1:] for r in taken(mix(df)).collect()] == [(0, 0, 0.0, 0)] * 2
    none = mix(df.where("false"))
    assert taken(none).count() == none.pieces.count() == none.sources.count() == 0
