"""Facts that the registered queries share, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.scalar import pct, rate
from cohortry.sources.tables import written as stored  # compressed; the shuffles of all order lines go with the write

CAPABILITIES = ["progression", "creation", "security", "resistance", "defence", "threat"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(x: str, digits: int = 0) -> str:
    """SQL of functions.scalar.rounded."""
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def div(x: str, y: str) -> str:
    return f"(CAST({x} AS DOUBLE) / nullif(CAST({y} AS DOUBLE), 0e0))"


def entity_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row a customer with orders: conditional counts over one scan of lineitem, grouped once."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = joined.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"), F.sum("l_quantity").alias("exposure"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
        F.count_if(F.col("l_discount") >= 0.05).alias("n_discounted"), F.count_if(F.col("l_quantity") >= 30).alias("n_big"),
        F.count_if(F.col("l_tax") >= 0.04).alias("n_taxed"), F.count_if(F.col("l_linenumber") % 2 == 1).alias("n_odd"),
    )
    dims = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return facts.join(dims, F.col("id") == F.col("c_custkey")).select(
        "id", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cohort"), F.col("n_name").alias("team"), "n_lines", "n_orders", "exposure",
        "n_returned", "n_open", "n_discounted", "n_big", "n_taxed", "n_odd", F.col("c_acctbal").alias("acctbal"),
    )


ENTITY = """entity AS (
SELECT o_custkey AS id, c_name AS name, c_mktsegment AS cohort, n_name AS team, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders,
  sum(l_quantity) AS exposure, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open,
  count(*) FILTER (WHERE l_discount >= 0.05e0) AS n_discounted, count(*) FILTER (WHERE l_quantity >= 30) AS n_big,
  count(*) FILTER (WHERE l_tax >= 0.04e0) AS n_taxed, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS n_odd, c_acctbal AS acctbal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY o_custkey, c_name, c_mktsegment, n_name, c_acctbal)"""

_RATES = {"progression": "n_returned", "creation": "n_open", "security": "n_discounted", "resistance": "n_big", "defence": "n_taxed", "threat": "n_odd"}


def entity_rates(spark: SparkSession, d: str) -> DataFrame:
    """entity_facts with six rates for 90 units of exposure, and the share of returned lines."""
    df = entity_facts(spark, d)
    rates = {f"{k}_rate": rate(F.col(v), F.col("exposure")) for k, v in _RATES.items()}
    return df.withColumns(rates | {"returned_pct": pct(F.col("n_returned"), F.col("n_lines"))})


RATES = (
    ENTITY
    + ",\nrates AS (SELECT *, "
    + ", ".join(f"{rnd(div(f'{v} * 90e0', 'exposure'), 3)} AS {k}_rate" for k, v in _RATES.items())
    + f", {rnd(div('n_returned * 100e0', 'n_lines'), 1)} AS returned_pct FROM entity)"
)


_frames: ContextVar[dict | None] = ContextVar("frames", default=None)


def per_query(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, in which all parts that ask for the scores of a folder get one frame, computed and written once.
    The next call computes its own: nothing outlives a query."""

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        token = _frames.set({})
        try:
            return query(spark, d)
        finally:
            _frames.reset(token)

    return run


def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    """id, cohort, team, n_orders, exposure and six scores: midrank percentiles of the rates in the cohort. Within a
    query (per_query) they are computed once."""
    frames = _frames.get()
    if frames is None:
        return _entity_scores(spark, d)
    if d not in frames:
        frames[d] = _entity_scores(spark, d)
    return frames[d]


def _entity_scores(spark: SparkSession, d: str) -> DataFrame:
    from cohortry.operators.cohort import midrank_percentiles

    df = stored(entity_rates(spark, d))
    metrics = [f"{c}_rate" for c in CAPABILITIES]
    scores = midrank_percentiles(df, ["cohort"], metrics, ["id"], suffix="")
    scores = scores.select("id", *[F.col(f"{c}_rate").alias(c) for c in CAPABILITIES])
    return stored(df.select("id", "name", "cohort", "team", "n_orders", "exposure").join(scores, "id"))


def midrank_sql(value: str, cohort: str = "cohort") -> str:
    mid = f"rank() OVER (PARTITION BY {cohort} ORDER BY {value} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {cohort}, {value}) - 1) / 2e0 - 0.5e0"
    return f"CASE WHEN {value} IS NULL THEN 0e0 ELSE {rnd(f'({mid}) / count(*) OVER (PARTITION BY {cohort}) * 100e0', 6)} END"


SCORES = (
    RATES
    + ",\nscores AS (SELECT id, name, cohort, team, n_orders, exposure, "
    + ", ".join(f"{midrank_sql(f'{c}_rate')} AS {c}" for c in CAPABILITIES)
    + " FROM rates)"
)
