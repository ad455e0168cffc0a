"""Codebooks and codes against plain loops, and odd vectors."""

import hashlib
import random

import numpy as np
import pytest

from cohortry.llm.vector_codes import decode, encode, label_errors, nearest, train

SCHEMA = "vec_id long, embedding array<float>, label int, code int, label_error string, __v int"


def test_nearest_equals_trying_all_entries():
    rng = np.random.default_rng(3)
    for width, spread in ((1, 3), (4, 3), (4, 200), (3, 1 << 27)):
        for size in (1, 2, 64):
            book, parts = (rng.integers(-spread, spread + 1, (n, width)) for n in (size, 500))
            away = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
            at, best = nearest(parts, book)
            assert (at == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()  # argmin takes the first of equals


def plain(vectors, parts, entries, rounds):
    """vectors: id -> list of floats, as (books, codes, errors) by the definition."""
    dim = len(next(iter(vectors.values())))
    width = dim // parts
    whole = {i: [[int(np.floor(256 * float(np.float32(x)))) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for i, v in vectors.items()}
    books = [[whole[i][p] for i in sorted(whole)[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((away(part, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for w in whole.values():
                held.setdefault(near(w[p], books[p])[1], []).append(w[p])
            books[p] = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(books[p])]
    found = {i: [near(w[p], books[p]) for p in range(parts)] for i, w in whole.items()}
    return books, {i: "".join(f"{j:02x}" for _, j in f) for i, f in found.items()}, {i: sum(d for d, _ in f) for i, f in found.items()}


def test_whole_operator_equals_loops_and_leaves_bad_vectors_out(spark):
    rng = random.Random(7)
    vectors = {i: [rng.choice([-1.0, -0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(8)] for i in range(150)}
    rows = [(i, v, rng.choice([1, 2, None]), 5, "x", 6) for i, v in vectors.items()]
    bad = [None, [], [None] * 8, [0.0] * 7 + [None], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [0.0] * 7 + [-float("inf")], [1.0] * 9]
    df = spark.createDataFrame(rows + [(1000 + i, v, 1, 5, "x", 6) for i, v in enumerate(bad)], SCHEMA).repartition(5)
    books = train(df, parts=4, entries=16, rounds=2)
    want, codes, errors = plain(vectors, 4, 16, 2)
    assert books.entries.tolist() == want
    assert books.digest() == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    got = {r["vec_id"]: r for r in label_errors(encode(df, books)).collect()}
    assert {i: r["code"] for i, r in got.items()} == codes and {i: r["error"] for i, r in got.items()} == errors
    for label in (1, 2, None):
        assert {r["label_error"] for r in got.values() if r["label"] == label} == {sum(errors[i] for i, *_ in rows if got[i]["label"] == label)}
    back = {r["vec_id"]: r["decoded"] for r in decode(encode(df, books), books).collect()}
    for i, v in vectors.items():  # the middle of the floored step is at most half a step off
        assert sum((x - y) ** 2 for x, y in zip(v, back[i], strict=True)) == pytest.approx(errors[i] / 256**2, abs=8 * (2 * max(map(abs, v)) + 8) / 256)


def test_few_repeated_unnumbered_and_huge_vectors(spark):
    rows = [(1, [1e30, -1e30, 0.5], 1), (1, [1e30, -1e30, 0.5], 1), (None, [0.0, 0.0, 0.0], None), (2, [0.5, 0.5, 0.5], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = train(df)
    assert books.entries.shape == (16, 4, 1)  # three components and thirteen zeros
    got = sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in encode(df, books).collect())
    assert len(got) == 4 and {x[2] for x in got} == {0} and got[1] == got[2]
    empty = df.where("false")
    assert encode(empty, train(empty)).count() == 0 and encode(df, train(empty)).count() == 0
    assert label_errors(encode(empty, books)).columns == ["vec_id", "embedding", "label", "code", "error", "label_error"]
