"""Numbers, tiles, scores and shrinkage in groups against plain loops, without windows over whole groups."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortry.operators import cohort as K


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, rng.uniform(0, 9)]), float(rng.randrange(90, 900))) for i in range(700)] + [(900, "one", 2.0, 90.0)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double, e double").repartition(6)


def groups(rows):
    return {k: [r for r in rows if r[1] == k] for k in ("a", "b", None, "one")}


def test_numbers_and_tiles(df, rows):
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    got = {r["id"]: (r["place"], r["__n"]) for r in K.numbered(df, ["k"], order, "place").collect()}
    tiles = {r["id"]: r["t"] for r in K.cohort_ntile(df, ["k"], order, "t", 7).collect()}
    for own in groups(rows).values():
        ordered = sorted(own, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in ordered] == [(i + 1, len(own)) for i in range(len(own))]
        size, extra = divmod(len(own), 7)
        assert [tiles[r[0]] for r in ordered] == [t + 1 for t in range(7) for _ in range(size + (t < extra))]
    plan = K.numbered(df, ["k"], order, "place")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "rangepartitioning" not in plan  # the rows were dealt and written before
    assert K.numbered(df.where("false"), ["k"], order, "place").isEmpty()


def test_scores_and_shrinkage(df, rows):
    z = {r["id"]: r["z"] for r in K.z_score(df, ["k"], "e", "z").collect()}
    below = {r["id"]: r["p"] for r in K.below_percentile(df, ["k"], "v", "p").collect()}
    drawn = {r["id"]: r["v_s"] for r in K.shrunk(df, ["v"], "e", ["k"], 90.0, 900.0, "_s").collect()}
    for own in groups(rows).values():
        es, vs = [r[3] for r in own], [r[2] for r in own if r[2] is not None]
        spread, mean = statistics.pstdev(es) or 1.0, statistics.fmean(vs)
        for i, _, v, e in own:
            assert z[i] == pytest.approx((e - statistics.fmean(es)) / spread)
            low = sum(v is not None and (r[2] is None or r[2] < v) for r in own)
            assert below[i] == int(low / len(own) * 100 + 0.5)
            w = (e - 90) / 810
            assert drawn[i] is None if v is None else drawn[i] == pytest.approx(v * w + mean * (1 - w))


def test_what_differs_from_run_to_run_is_written_once(df):
    """Approximate quantiles and sums of doubles depend on the order in which tasks end: two computations of them in one
    plan gave ranks that didn't fit together."""
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan(K.group_ranks(df, ["k"], "v"))
    assert "percentile_approx" not in plan(K.midrank_percentiles(df, ["k"], ["v", "e"], ["id"]))
    shrunk = plan(K.shrunk(df, ["v"], "e", ["k"], 90.0, 900.0))
    assert "avg(" not in shrunk and "LogicalRDD" in shrunk
    assert "avg(" not in plan(K.z_score(df, ["k"], "e", "z"))
