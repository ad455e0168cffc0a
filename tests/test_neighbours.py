"""Nearest neighbours by pivots against all pairs, and quantiles by selection against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators.cohort import exact_quantiles
from cohortry.operators.decisions import fit_of
from cohortry.operators.neighbours import neighbours

SCORES = ["x", "y", "z"]


def fit(a, b):
    d = sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)) ** 0.5
    return int(max(0.0, min(100.0, (1.0 - d / 245.0) * 100.0)) * 1e6 + 0.5) / 1e6


def by_pairs(rows, k, reach=None, apart=False, asked=lambda i: True):
    out = set()
    for i, g, t, *v in rows:
        if not asked(i) or None in (g, *v):
            continue
        near = [(-fit(v, w), j) for j, h, u, *w in rows if j != i and h == g and None not in w and not (apart and u == t)]
        if reach is not None:
            near = [n for n in near if -n[0] >= fit([0.0], [reach])]
        out |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(sorted(near)[:k])}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, t string, x double, y double, z double")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    many = [(i, rng.choice("ab"), rng.choice("uvw"), *[rng.choice([0.0, 100.0, rng.uniform(0, 100)]) for _ in range(3)]) for i in range(300)]
    many += [(1000 + i, "a", "u", 50.0, 50.0, 50.0) for i in range(60)]  # equal vectors of one team
    return many + [(2000, "c", "u", 1.0, 2.0, 3.0), (2001, None, "u", 1.0, 2.0, 3.0), (2002, "a", "v", None, 2.0, 3.0), (2003, "d", "u", 1.0, 1.0, 1.0), (2004, "d", "v", 99.0, 99.0, 99.0)]


@pytest.mark.parametrize("apart", [False, True])
def test_equals_all_pairs(spark, rows, apart):
    got = neighbours(table(spark, rows), "id", "g", SCORES, 3, fit_of, apart="t" if apart else None).ranked.collect()
    want = by_pairs(rows, 3, apart=apart)
    assert len(got) == len(want) and {(r["id"], r["candidate"], round(r["score"], 5), r["rank"]) for r in got} == {(i, j, round(s, 5), r) for i, j, s, r in want}


def test_reach_and_asked_rows(spark, rows):
    got = neighbours(table(spark, rows), "id", "g", SCORES, 5, fit_of, reach=12.25, asked=F.col("id") % 10 == 0).ranked.collect()
    want = by_pairs(rows, 5, reach=12.25, asked=lambda i: i % 10 == 0)
    assert {(r["id"], r["candidate"], r["rank"]) for r in got} == {(i, j, r) for i, j, _, r in want}
    assert neighbours(table(spark, rows).where("false"), "id", "g", SCORES, 3, fit_of).ranked.isEmpty()


def test_pairs_compared_grow_slower_than_the_square(spark):
    def compared(n):
        df = spark.range(n).select("id", F.lit("a").alias("g"), *[(F.rand(i) * 100).alias(c) for i, c in enumerate(SCORES)])
        return neighbours(df, "id", "g", SCORES, 3, fit_of).visits.agg(F.sum("n")).first()[0]

    small, large = compared(500), compared(4000)
    assert large < 0.12 * 4000**2 and large < 8**1.75 * small


@pytest.mark.parametrize("settled", [5, 100_000])
def test_quantiles_equal_sorted_lists(spark, settled):
    rng = random.Random(9)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 7.0, rng.gauss(0, 100), float(rng.randrange(9))])) for _ in range(900)] + [("one", 3.5), ("none", None)]
    shares = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(spark.createDataFrame(data, "k string, x double"), ["k"], "x", shares, settled, cuts=4).collect()}
    for k in ("a", "b", None, "one"):
        own = sorted(v for g, v in data if g == k and v is not None)
        at = lambda p: (own[int(p)] + (own[min(int(p) + 1, len(own) - 1)] - own[int(p)]) * (p - int(p)))
        assert got[k] == pytest.approx([at(p * (len(own) - 1)) for p in shares])
    assert "none" not in got
    whole = exact_quantiles(spark.createDataFrame(data, "k string, x double"), [], "x", [0.5], settled, cuts=4).first()["q"]
    own = sorted(v for _, v in data if v is not None)
    assert whole == pytest.approx([(own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2])
