"""Marts, rates, cohort standings and candidates over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.scalar import bands, difference, pct, possession_factor, ratio, result_label, rounded, weighted
from cohortry.operators import cohort as K

from cohortry.sources.tables import stored

from .base import CAPABILITIES, RATES, div, entity_facts, entity_rates, midrank_sql, rnd, table, ENTITY

QUERIES, ORACLES = {}, {}


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Marts (E1-E8, F1-F14, J1-J6)

@register(f"""
WITH e AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS home, count(*) FILTER (WHERE l_returnflag = 'A') AS away,
  coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0e0) AS home_qty, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0e0) AS away_qty FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n_events, coalesce(home, 0) AS home_events, coalesce(away, 0) AS away_events,
  CASE WHEN coalesce(home, 0) > coalesce(away, 0) THEN 'Home Win' WHEN coalesce(home, 0) < coalesce(away, 0) THEN 'Away Win' ELSE 'Draw' END AS result,
  CASE WHEN coalesce(home, 0) + coalesce(away, 0) >= 4 THEN 'High Scoring' WHEN coalesce(home, 0) + coalesce(away, 0) = 0 THEN 'Goalless' ELSE 'Normal' END AS match_classification,
  {rnd('coalesce(home_qty, 0e0) - coalesce(away_qty, 0e0)', 3)} AS qty_differential, {rnd(div('coalesce(home, 0) * 100e0', 'coalesce(home, 0) + coalesce(away, 0)'), 1)} AS home_share_pct
FROM orders LEFT JOIN e ON o_orderkey = l_orderkey""")
def match_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row an order, with both sides pivoted in one aggregation."""
    side = lambda flag: F.col("l_returnflag") == flag
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(side("R")).alias("home"), F.count_if(side("A")).alias("away"),
        F.sum(F.when(side("R"), F.col("l_quantity"))).alias("home_qty"), F.sum(F.when(side("A"), F.col("l_quantity"))).alias("away_qty"),
    )
    j = table(spark, d, "orders").join(e, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["n", "home", "away"])
    goals = F.col("home") + F.col("away")
    kind = F.when(goals >= 4, "High Scoring").when(goals == 0, "Goalless").otherwise("Normal")
    return j.select(
        "o_orderkey", F.col("n").alias("n_events"), F.col("home").alias("home_events"), F.col("away").alias("away_events"),
        result_label(F.col("home"), F.col("away"), ("Home Win", "Away Win", "Draw")).alias("result"), kind.alias("match_classification"),
        difference(F.col("home_qty"), F.col("away_qty")).alias("qty_differential"), pct(F.col("home"), goals).alias("home_share_pct"),
    )


@register(f"""
WITH m AS (SELECT l_orderkey AS id, c_mktsegment AS home_team, o_orderpriority AS away_team, count(*) FILTER (WHERE l_returnflag = 'R') AS hs, count(*) FILTER (WHERE l_returnflag = 'A') AS aws
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
t AS (SELECT id, home_team AS team, hs AS f, aws AS a FROM m UNION ALL SELECT id, away_team, aws, hs FROM m)
SELECT team, count(*) AS matches_played, count(*) FILTER (WHERE f > a) AS wins, count(*) FILTER (WHERE f = a) AS draws, count(*) FILTER (WHERE f < a) AS losses,
  count(*) FILTER (WHERE f > a) * 3 + count(*) FILTER (WHERE f = a) AS points, CAST(sum(f) AS BIGINT) AS goals_scored, CAST(sum(a) AS BIGINT) AS goals_conceded,
  CAST(sum(f) - sum(a) AS BIGINT) AS goal_difference, {rnd(div('sum(f)', 'count(*)'), 2)} AS avg_goals_scored FROM t GROUP BY team""")
def home_away_union(spark: SparkSession, d: str) -> DataFrame:
    """League table: both perspectives of a match by one explode, no second scan."""
    m = (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("l_orderkey", "c_mktsegment", "o_orderpriority")
        .agg(F.count_if(F.col("l_returnflag") == "R").alias("hs"), F.count_if(F.col("l_returnflag") == "A").alias("aws"))
    )
    from cohortry.operators.marts import both_sides, league_table

    return league_table(both_sides(m, ("c_mktsegment", "hs"), ("o_orderpriority", "aws")), ["team"])


@register(f"WITH {ENTITY} SELECT id, cohort, team, n_lines, n_orders, exposure, n_returned, n_open, n_discounted, n_big, n_taxed, n_odd FROM entity")
def entity_summary_fused(spark: SparkSession, d: str) -> DataFrame:
    """Nine conditional measures by one scan and one aggregation."""
    return entity_facts(spark, d).drop("name", "acctbal")


@register("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute FROM events),
dur AS (SELECT day, max(minute) AS dur FROM s GROUP BY 1),
a AS (SELECT user_id, day, min(minute) FILTER (WHERE event_type = (SELECT min(event_type) FROM events)) AS off, min(minute) AS first,
  bool_or(event_type = (SELECT max(event_type) FROM events)) AS starter FROM s GROUP BY 1, 2)
SELECT user_id, CAST(sum(CASE WHEN starter THEN coalesce(off, dur) ELSE dur - first END) AS BIGINT) AS minutes_played, count(*) AS matches_played FROM a JOIN dur USING (day) GROUP BY 1""")
def minutes_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of users over days: starters until their first exit event, others from their first event."""
    e = table(spark, d, "events")
    kinds = e.agg(F.min("event_type").alias("exit"), F.max("event_type").alias("start"))
    s = e.crossJoin(F.broadcast(kinds)).select("user_id", F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), (F.col("event_type") == F.col("exit")).alias("is_exit"), (F.col("event_type") == F.col("start")).alias("is_start"))
    a = s.groupBy("user_id", "day").agg(F.min(F.when(F.col("is_exit"), F.col("minute"))).alias("off"), F.min("minute").alias("first"), F.bool_or("is_start").alias("starter"))
    dur = s.groupBy("day").agg(F.max("minute").alias("dur"))
    m = F.when(F.col("starter"), F.coalesce("off", "dur")).otherwise(F.col("dur") - F.col("first"))
    return a.join(dur, "day").groupBy("user_id").agg(F.sum(m).cast("long").alias("minutes_played"), F.count("*").alias("matches_played"))


@register(f"""
WITH c AS (SELECT o_custkey AS id, o_orderpriority AS p, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS total,
  row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r, count(*) OVER (PARTITION BY o_custkey) AS kinds FROM orders GROUP BY 1, 2)
SELECT id, max(p) FILTER (WHERE r = 1) AS position_name, max(p) FILTER (WHERE r = 2) AS secondary_position_name,
  {rnd(div('max(n) FILTER (WHERE r = 1)', 'max(total)'), 2)} AS position_confidence, max(kinds) AS positions_played_count FROM c GROUP BY id""")
def primary_secondary_mode(spark: SparkSession, d: str) -> DataFrame:
    """Most and second most frequent value of each entity in one aggregation after one window."""
    from cohortry.operators.marts import primary_and_secondary

    return primary_and_secondary(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p")), ["id"], "p")


@register(f"""
WITH t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS home FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, {rnd(div('home * 100e0', 'n'), 1)} AS poss FROM t)
SELECT l_suppkey, {rnd("sum(l_quantity * (2e0 / (1e0 + exp(-0.1e0 * (CASE WHEN l_returnflag = 'R' THEN poss ELSE 100e0 - poss END - 50e0)))))", 3)} AS padj_quantity
FROM lineitem JOIN p USING (l_orderkey) GROUP BY 1""")
def sigmoid_adjusted_sum(spark: SparkSession, d: str) -> DataFrame:
    """Possession-adjusted sums."""
    li = table(spark, d, "lineitem")
    p = li.groupBy("l_orderkey").agg(pct(F.count_if(F.col("l_returnflag") == "R"), F.count("*")).alias("poss"))
    own = F.when(F.col("l_returnflag") == "R", F.col("poss")).otherwise(100.0 - F.col("poss"))
    return li.join(p, "l_orderkey").groupBy("l_suppkey").agg(rounded(F.sum(F.col("l_quantity") * possession_factor(own)), 3).alias("padj_quantity"))


_RATE_COLUMNS = [f"{c}_rate" for c in CAPABILITIES]


@register(f"WITH {RATES} SELECT id, {', '.join(_RATE_COLUMNS)}, returned_pct FROM rates")
def rates_per_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Exposure-normalised rates."""
    return entity_rates(spark, d).select("id", *_RATE_COLUMNS, "returned_pct")


# Standings (G, K)

def _percent_rank(v: str) -> str:
    return rnd(f"percent_rank() OVER (PARTITION BY cohort ORDER BY {v} ASC NULLS FIRST) * 100e0", 1)


_PCTS = ", ".join(f"{_percent_rank(v)} AS {v}_pct" for v in _RATE_COLUMNS)
_OVERALL = {"progression_rate_pct": 0.35, "creation_rate_pct": 0.25, "security_rate_pct": 0.2, "threat_rate_pct": 0.2}
_CONTRIBUTION = {"progression_rate_pct": 0.4, "creation_rate_pct": 0.25, "security_rate_pct": 0.2, "resistance_rate_pct": 0.15}
_SUM = lambda terms: " + ".join(f"{k} * {v}e0" for k, v in terms.items())


@register(f"WITH {RATES}, p AS (SELECT id, cohort, {_PCTS} FROM rates WHERE n_orders >= 1 AND n_lines >= 10) SELECT *, {rnd(_SUM(_OVERALL), 1)} AS overall_percentile FROM p")
def percentiles_in_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Percent ranks in the cohort for qualified entities, and their weighted composite."""
    q = entity_rates(spark, d).where("n_orders >= 1 AND n_lines >= 10")
    q = stored(q)
    return K.cohort_percent_rank(q, ["cohort"], _RATE_COLUMNS, ["id"]).withColumn("overall_percentile", weighted(_OVERALL, 1))


@register(f"WITH {ENTITY} SELECT id, {rnd('percent_rank() OVER (ORDER BY n_returned ASC NULLS FIRST) * 100e0', 1)} AS returned_pct_overall FROM entity")
def global_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Percent rank over all entities without a single task."""
    return K.global_percent_rank(stored(entity_facts(spark, d).select("id", "n_returned")), "n_returned", "returned_pct_overall").select("id", "returned_pct_overall")


@register(f"WITH {RATES} SELECT id, ntile(10) OVER (ORDER BY exposure ASC NULLS FIRST, id) AS decile, ntile(10) OVER (PARTITION BY cohort ORDER BY progression_rate ASC NULLS FIRST, id) AS decile_in_cohort FROM rates")
def deciles(spark: SparkSession, d: str) -> DataFrame:
    """Exact deciles over all entities and in the cohort."""
    df = K.global_ntile(stored(entity_rates(spark, d).select("id", "cohort", "exposure", "progression_rate")), "exposure", "id", "decile")
    df = K.cohort_ntile(df, ["cohort"], [F.col("progression_rate").asc_nulls_first(), F.col("id")], "decile_in_cohort")
    return df.select("id", "decile", "decile_in_cohort")


_CANDIDATES = f"""{RATES}, p AS (SELECT *, {_PCTS} FROM rates WHERE n_orders >= 2 AND n_lines >= 20),
s AS (SELECT *, {rnd(_SUM(_CONTRIBUTION), 1)} AS contribution_score FROM p),
candidates AS (SELECT id, cohort, team, n_orders, contribution_score, row_number() OVER (PARTITION BY cohort ORDER BY contribution_score DESC, exposure DESC, id) AS position_rank,
  count(*) OVER (PARTITION BY cohort) AS position_pool_size, progression_rate_pct >= 65 AS is_progressive, security_rate_pct >= 60 AND n_orders >= 10 AS is_high_volume, returned_pct > 50 AND n_returned >= 2 AS is_clinical,
  threat_rate_pct >= 65 AS is_carrier, resistance_rate_pct >= 70 AND returned_pct >= 40 AS is_dribbler, coalesce(n_big > 0 AND {div('n_big', 'n_lines')} > 0.45, false) AS is_efficient FROM s)"""


def _best_first() -> list:
    return [F.desc("contribution_score"), F.desc("exposure"), F.col("id")]


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    q = stored(entity_rates(spark, d).where("n_orders >= 2 AND n_lines >= 20"))
    return q.join(K.cohort_percent_rank(q, ["cohort"], _RATE_COLUMNS, ["id"]).drop("cohort"), "id").withColumn("contribution_score", weighted(_CONTRIBUTION, 1))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return K.numbered(_contributions(spark, d), ["cohort"], _best_first(), "position_rank", "position_pool_size").select(
        "id", "cohort", "team", "n_orders", "contribution_score", "position_rank", "position_pool_size", (F.col("progression_rate_pct") >= 65).alias("is_progressive"),
        ((F.col("security_rate_pct") >= 60) & (F.col("n_orders") >= 10)).alias("is_high_volume"), ((F.col("returned_pct") > 50) & (F.col("n_returned") >= 2)).alias("is_clinical"),
        (F.col("threat_rate_pct") >= 65).alias("is_carrier"), ((F.col("resistance_rate_pct") >= 70) & (F.col("returned_pct") >= 40)).alias("is_dribbler"),
        F.coalesce((F.col("n_big") > 0) & (F.col("n_big") / F.nullif(F.col("n_lines"), F.lit(0)) > 0.45), F.lit(False)).alias("is_efficient"),
    )


@register(f"WITH {_CANDIDATES} SELECT * FROM candidates")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Composite score, rank, pool size and flags (V5: E9, G4, G5, J5, J7)."""
    return _candidates(spark, d)


@register(f"WITH {_CANDIDATES} SELECT id, cohort, contribution_score, position_rank FROM candidates WHERE position_rank <= 5")
def topn_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each cohort."""
    best = K.top_k(_contributions(spark, d), ["cohort"], _best_first(), 5, "position_rank")
    return best.select("id", "cohort", "contribution_score", "position_rank")


@register(f"""WITH {RATES}, w AS (SELECT id, cohort, progression_rate, creation_rate, least(greatest((exposure - 90e0) / 810e0, 0e0), 1e0) AS w FROM rates)
SELECT id, {rnd('progression_rate * w + avg(progression_rate) OVER (PARTITION BY cohort) * (1e0 - w)', 6)} AS progression_shrunk,
  {rnd('creation_rate * w + avg(creation_rate) OVER (PARTITION BY cohort) * (1e0 - w)', 6)} AS creation_shrunk FROM w""")
def shrunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates drawn to the cohort's mean by exposure."""
    names = ["progression", "creation"]
    df = K.shrunk(stored(entity_rates(spark, d)), [f"{m}_rate" for m in names], "exposure", ["cohort"], 90.0, 900.0)
    return df.select("id", *[rounded(F.col(f"{m}_rate"), 6).alias(f"{m}_shrunk") for m in names])


@register(f"WITH {RATES} SELECT id, cohort, {', '.join(f'{midrank_sql(v)} AS {v}_mid' for v in _RATE_COLUMNS)} FROM rates")
def midrank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Midrank percentiles of six metrics with one window."""
    return K.midrank_percentiles(stored(entity_rates(spark, d)), ["cohort"], _RATE_COLUMNS, ["id"])


@register(f"""WITH {RATES} SELECT id, {rnd('(exposure - avg(exposure) OVER w) / CASE WHEN stddev_pop(exposure) OVER w = 0 THEN 1e0 ELSE stddev_pop(exposure) OVER w END', 6)} AS z,
  least(1e0, n_orders / 10e0) AS confidence, {rnd('(rank() OVER (PARTITION BY cohort ORDER BY exposure NULLS FIRST) - 1) * 1e0 / count(*) OVER w * 100e0')} AS below_pct FROM rates WINDOW w AS (PARTITION BY cohort)""")
def z_scores(spark: SparkSession, d: str) -> DataFrame:
    """z-scores, strictly-below percentiles and sample confidence."""
    df = stored(entity_facts(spark, d).select("id", "cohort", "exposure", "n_orders"))
    df = K.z_score(K.below_percentile(df, ["cohort"], "exposure", "below_pct"), ["cohort"], "exposure", "z")
    return df.select("id", rounded(F.col("z"), 6).alias("z"), K.confidence(F.col("n_orders")).alias("confidence"), "below_pct")


@register(f"SELECT event_id, {rnd('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 4)} AS rolling_value FROM events")
def rolling_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each user's last five events."""
    return table(spark, d, "events").select("event_id", rounded(K.rolling_mean("value", ["user_id"], ["ts", "event_id"]), 4).alias("rolling_value"))


@register(f"""WITH {ENTITY}, q AS (SELECT cohort, quantile_cont(exposure, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM entity GROUP BY 1)
SELECT cohort, {', '.join(f"{rnd(f'q[{i + 1}]', 4)} AS p{p}" for i, p in enumerate((10, 25, 50, 75, 90, 95, 99)))} FROM q""")
def calibration_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles by cohort, by distributed selection."""
    ps = (10, 25, 50, 75, 90, 95, 99)
    q = K.exact_quantiles(entity_facts(spark, d), ["cohort"], "exposure", [p / 100 for p in ps])
    return q.select("cohort", *[rounded(F.get("q", F.lit(i)), 4).alias(f"p{p}") for i, p in enumerate(ps)])


_PAIRS = [(a, b) for i, a in enumerate(CAPABILITIES) for b in CAPABILITIES[i + 1 :]]


@register(f"WITH {RATES} SELECT " + ", ".join(f"{rnd(f'corr({a}_rate, {b}_rate)', 6)} AS {a}_{b}" for a, b in _PAIRS) + " FROM rates")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    """All pairwise correlations in one aggregation."""
    return entity_rates(spark, d).agg(*[rounded(F.corr(f"{a}_rate", f"{b}_rate"), 6).alias(f"{a}_{b}") for a, b in _PAIRS])


@register(f"WITH {ENTITY} SELECT id, cohort, team, n_orders FROM entity WHERE cohort = 'BUILDING' AND team IS NOT NULL AND n_orders >= 5 AND (name ILIKE '%1%' OR exposure BETWEEN 100 AND 400)")
def filtered_entities(spark: SparkSession, d: str) -> DataFrame:
    """Optional filters, ranges and case-blind patterns reach the scan."""
    from cohortry.operators.filters import where_all

    df = where_all(entity_facts(spark, d), {"cohort": "BUILDING", "team": None}, minimum={"n_orders": 5})
    return df.where(F.col("team").isNotNull() & (F.col("name").ilike("%1%") | F.col("exposure").between(100, 400))).select("id", "cohort", "team", "n_orders")


@register("SELECT count(DISTINCT id) AS players, count(*) FILTER (WHERE n_orders >= 10) AS regulars, count(DISTINCT team) AS teams FROM (WITH " + ENTITY + " SELECT * FROM entity)")
def dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Distinct and conditional counts."""
    return entity_facts(spark, d).agg(F.countDistinct("id").alias("players"), F.count_if(F.col("n_orders") >= 10).alias("regulars"), F.countDistinct("team").alias("teams"))


@register("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, value FROM r WHERE k = 1""")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    return K.first_by(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value")


@register("SELECT event_id, TRY_CAST(props::JSON ->> '$.k' AS BIGINT) AS k, coalesce(CAST(props::JSON ->> '$.missing' AS VARCHAR), 'none') AS missing FROM events")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested fields by an explicit schema, with defaults."""
    p = F.from_json("props", "k long, missing string")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("missing"))


@register("""WITH m AS (SELECT o_custkey AS id, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) AS k FROM m) SELECT id, p AS modal_priority FROM r WHERE k = 1""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent value, the smallest in a tie."""
    return K.modal(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p")), ["id"], "p", "modal_priority")


@register(f"""WITH {ENTITY} SELECT id, CASE WHEN n_orders >= 25 THEN 'High' WHEN n_orders >= 15 THEN 'Medium' ELSE 'Low' END AS reliability,
  CASE WHEN contains(lower(cohort), 'build') THEN 'B' WHEN contains(lower(cohort), 'auto') THEN 'A' ELSE 'Other' END AS cohort_group, substr(sha256(name || ':' || cohort), 1, 16) AS entity_hash,
  lower(replace(team || '__' || cohort, ' ', '_')) AS entity_key FROM entity""")
def labels_and_ids(spark: SparkSession, d: str) -> DataFrame:
    """Bands, ordered substring rules, hashed ids and keys."""
    from cohortry.functions.scalar import entity_key, short_id

    low = F.lower("cohort")
    group = F.when(F.contains(low, F.lit("build")), "B").when(F.contains(low, F.lit("auto")), "A").otherwise("Other")
    return entity_facts(spark, d).select(
        "id", bands(F.col("n_orders"), [(25, "High"), (15, "Medium")], "Low").alias("reliability"), group.alias("cohort_group"),
        short_id(F.col("name"), F.col("cohort")).alias("entity_hash"), entity_key(F.col("team"), F.col("cohort")).alias("entity_key"),
    )
