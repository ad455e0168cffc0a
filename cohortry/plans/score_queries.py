"""Scores, teams, decisions and roll-ups over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import ERF_A, ERF_P, age_years, rounded, weighted
from cohortry.operators import cohort as K
from cohortry.operators import decisions as D
from cohortry.operators import scoring as S
from cohortry.operators import teams as T
from cohortry.operators.neighbours import neighbours

from .base import CAPABILITIES, RATES, SCORES, div, entity_facts, entity_rates, entity_scores, rnd, table


QUERIES, ORACLES = {}, {}


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def sql_sum(terms: dict[str, float]) -> str:
    return " + ".join(f"{k} * {float(v)}e0" for k, v in terms.items())


def sql_bands(x: str, cuts: list, below: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {c} THEN '{v}'" for c, v in cuts) + f" WHEN {x} IS NOT NULL THEN '{below}' END"


_CASES = {"BUILDING": {"security": 0.4, "resistance": 0.05, "progression": 0.45, "threat": 0.1}}
_DEFAULT = {"security": 0.35, "resistance": 0.15, "progression": 0.4, "threat": 0.1}


@register(f"WITH {SCORES} SELECT id, {rnd(f'''CASE WHEN cohort = 'BUILDING' THEN {sql_sum(_CASES['BUILDING'])} ELSE {sql_sum(_DEFAULT)} END''', 4)} AS weighted_score FROM scores")
def weighted_capability(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score with weights by group (L1)."""
    return entity_scores(spark, d).select("id", rounded(S.by_group("cohort", _CASES, _DEFAULT), 4).alias("weighted_score"))


_ACTIVE, _CONTROL = {"progression": 0.25, "creation": 0.25, "security": 0.25, "resistance": 0.25}, {"defence": 0.6, "threat": 0.4}


@register(f"WITH {SCORES} SELECT id, {rnd(f'greatest({sql_sum(_ACTIVE)}, defence * 0.6e0 + (100e0 - threat) * 0.4e0)', 4)} AS best_score FROM scores")
def max_of_two_scores(spark: SparkSession, d: str) -> DataFrame:
    """The larger of two composites, one with an inverted metric (L2)."""
    return entity_scores(spark, d).select("id", S.best_of(_ACTIVE, _CONTROL, {"threat"}, 4).alias("best_score"))


@register(f"""WITH {SCORES}, p AS (SELECT o_custkey AS id, count(DISTINCT o_orderpriority) AS positions FROM orders GROUP BY 1),
x AS (SELECT s.*, CASE WHEN positions >= 4 THEN 100e0 WHEN positions = 3 THEN 70e0 WHEN positions = 2 THEN 40e0 ELSE 0e0 END AS pos,
  CASE WHEN greatest(threat, defence) > 0 THEN least(threat, defence) / greatest(threat, defence) * 100e0 ELSE 0e0 END AS balance FROM scores s JOIN p USING (id))
SELECT id, {rnd('CASE WHEN n_orders < 8 THEN pos * 0.1e0 + 50e0 * 0.55e0 + balance * 0.35e0 ELSE pos * 0.25e0 + 50e0 * 0.4e0 + balance * 0.35e0 END', 4)} AS versatility,
  {rnd('least(100e0, least(1e0, n_orders / 38e0) * 60e0 + 50e0 * 0.4e0)', 4)} AS availability FROM x""")
def versatility(spark: SparkSession, d: str) -> DataFrame:
    """Versatility and availability (L3, L4)."""
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.countDistinct("o_orderpriority").alias("positions"))
    s = entity_scores(spark, d).join(p, "id")
    return s.select(
        "id", rounded(S.versatility(F.col("positions"), CAPABILITIES, F.col("n_orders") < 8), 4).alias("versatility"),
        rounded(S.availability(F.least(F.lit(1.0), F.col("n_orders") / 38.0), F.lit(50.0)), 4).alias("availability"),
    )


#: Templates of the demonstration: a few shapes of the six scores.
_TEMPLATES = {"Finisher": (40, 50, 50, 50, 30, 100), "Complete": (75, 80, 80, 80, 60, 90), "Playmaker": (90, 100, 85, 80, 40, 70), "Anchor": (70, 40, 90, 100, 85, 20), "Stopper": (50, 20, 70, 60, 100, 10)}
_T_SQL = "t(template, " + ", ".join(f"t_{c}" for c in CAPABILITIES) + ") AS (VALUES " + ", ".join(f"('{k}', {', '.join(f'{float(x)}e0' for x in v)})" for k, v in _TEMPLATES.items()) + ")"
_DOT = " + ".join(f"{c} * t_{c}" for c in CAPABILITIES)
_NA = "sqrt(" + " + ".join(f"{c} * {c}" for c in CAPABILITIES) + ")"
_NB = "sqrt(" + " + ".join(f"t_{c} * t_{c}" for c in CAPABILITIES) + ")"
_DIST = "sqrt(" + " + ".join(f"({c} - t_{c}) * ({c} - t_{c})" for c in CAPABILITIES) + ")"
_SIM = rnd(f"coalesce(({_DOT}) / nullif({_NA} * {_NB}, 0e0), 0e0) * 0.75e0 + greatest(0e0, 1e0 - {_DIST} / 245e0) * 0.25e0", 6)


@register(f"""WITH {SCORES}, {_T_SQL}, s AS (SELECT id, template, {_SIM} AS similarity FROM scores, t),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, template) AS rank FROM s)
SELECT id, rank, CASE WHEN similarity < 0.3e0 THEN 'Unknown' ELSE template END AS template, similarity FROM r WHERE rank <= 3""")
def archetype_match(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar templates of each entity."""
    t = spark.createDataFrame([(k, *map(float, v)) for k, v in _TEMPLATES.items()], ["template", *[f"t_{c}" for c in CAPABILITIES]])
    return S.best_templates(entity_scores(spark, d), "id", CAPABILITIES, t)


_ROLES = {
    "Attack": {"threat": 3.5, "creation": 1.5, "progression": 1.0, "security": 1.0, "resistance": 1.5, "defence": 0.5},
    "Control": {"progression": 3.0, "security": 3.0, "resistance": 2.5, "creation": 1.5, "defence": 1.5, "threat": 0.5},
}


def _rating(w: dict[str, float]) -> str:
    return f"({sql_sum({c: w[c] for c in CAPABILITIES})}) / {sum(w.values())}e0"


def _sql_cdf(z: str) -> str:
    u = f"(abs({z}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + {ERF_P}e0 * {u}))"
    poly = "0e0"
    for a in reversed(ERF_A):
        poly = f"{t} * ({a}e0 + {poly})"
    erf = f"(1e0 - ({poly}) * exp(-{u} * {u}))"
    return f"CASE WHEN {z} >= 0 THEN (1e0 + {erf}) / 2e0 ELSE (1e0 - {erf}) / 2e0 END"


def _sql_curve(x: str) -> str:
    k = S.RATING_KNOTS
    parts = [f"WHEN {x} <= {k[0][0]}e0 THEN {k[0][1]}e0"]
    parts += [f"WHEN {x} <= {x1}e0 THEN {y0}e0 + ({x} - {x0}e0) * {(y1 - y0) / (x1 - x0)!r}" for (x0, y0), (x1, y1) in zip(k, k[1:])]
    return "CASE " + " ".join(parts) + f" ELSE {k[-1][1]}e0 END"


@register(f"""WITH {SCORES}, r AS (SELECT id, CASE WHEN threat >= defence THEN 'Attack' ELSE 'Control' END AS family, * EXCLUDE (id) FROM scores),
v AS (SELECT id, family, {rnd(f'''CASE WHEN family = 'Attack' THEN {_rating(_ROLES['Attack'])} ELSE {_rating(_ROLES['Control'])} END''', 1)} AS rating FROM r),
z AS (SELECT *, (rating - avg(rating) OVER w) / CASE WHEN stddev_pop(rating) OVER w = 0 THEN 1e0 ELSE stddev_pop(rating) OVER w END AS z FROM v WINDOW w AS (PARTITION BY family)),
p AS (SELECT *, ({_sql_cdf('z')}) * 100e0 AS p FROM z)
SELECT id, family, rating, {rnd('z', 2)} AS z_score, {rnd('p', 1)} AS rating_percentile, {rnd(f'least(greatest({_sql_curve("p")}, 0e0), 99.9e0)', 1)} AS display_rating FROM p""")
def role_rating_z(spark: SparkSession, d: str) -> DataFrame:
    """Role-weighted rating, its z-score in the role, normal percentile and calibrated display."""
    s = entity_scores(spark, d).withColumn("family", F.when(F.col("threat") >= F.col("defence"), "Attack").otherwise("Control"))
    r = s.withColumn("rating", S.role_rating(CAPABILITIES, _ROLES, "family"))
    return S.presented_rating(r, "rating", ["family"]).select("id", "family", "rating", "z_score", "rating_percentile", "display_rating")


#: The twenty rules, with the scores of the demonstration in the place of metrics and percentiles.
_RULES = [
    ("elite_goal_scorer", "threat >= 85"), ("strong_chance_creator", "creation >= 80"), ("clinical_finisher", "threat > creation AND n_orders * threat >= 900"),
    ("xg_efficient_attacker", "threat > 10 * n_orders"), ("dual_threat_forward", "threat >= 70 AND creation >= 70"), ("elite_ball_progressor", "progression >= 85"),
    ("progressive_fullback", "progression >= 75 AND creation >= 60 AND cohort = 'BUILDING'"), ("line_breaking_passer", "progression >= 80 AND security >= 50"),
    ("ball_carrying_threat", "progression >= 80 AND threat >= 50"), ("high_press_resistant", "resistance >= 80"), ("technical_ball_retainer", "security >= 80"),
    ("reliable_passer", "security > 85 AND progression > 50"), ("defensive_specialist", "defence >= 85"), ("high_intensity_presser", "defence >= 80 AND resistance >= 50"),
    ("ball_winner", "defence >= 75"), ("tactically_versatile", "least(threat, defence) >= 80"), ("box_to_box_profile", "progression >= 70 AND defence >= 70"),
    ("well_rounded", " AND ".join(f"{c} >= 60" for c in CAPABILITIES)), ("low_availability_risk", "n_orders >= 25"), ("small_sample_warning", "n_orders < 5"),
]
_SIGNALS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES) + "], lambda x: x IS NOT NULL), ',')"


@register(f"WITH {SCORES} SELECT id, {_SIGNALS} AS signals, CASE WHEN exposure >= 450 THEN true ELSE false END AS sufficient FROM scores")
def signals(spark: SparkSession, d: str) -> DataFrame:
    """Threshold rules as a list of names."""
    rules = [(n, F.expr(c)) for n, c in _RULES]
    return entity_scores(spark, d).select("id", F.array_join(S.signals(rules), ",").alias("signals"), (F.col("exposure") >= 450).alias("sufficient"))


_YEARLY = """yearly AS (SELECT o_custkey AS id, year(o_orderdate) AS season, sum(l_quantity) AS exposure, count(*) AS n_lines,
  count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _yearly(spark: SparkSession, d: str, *more: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("season"), *more)
    return g.agg(F.sum("l_quantity").alias("exposure"), F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))


_RETURNED = rnd(div("n_returned * 90e0", "exposure"), 3)
_ROLL = f"""coalesce({rnd(div('sum(rate * exposure / 90e0) * 90e0', 'sum(exposure)'), 3)}, 0e0) AS rate, CAST(sum(n_returned) AS BIGINT) AS n_returned,
  CAST(sum(n_lines) AS BIGINT) AS n_lines, coalesce({rnd(div('sum(n_returned) * 100e0', 'sum(n_lines)'), 1)}, 0e0) AS returned_pct, sum(exposure) AS exposure, count(*) AS n_vectors"""


def _vectors(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    from cohortry.functions.scalar import rate

    return _yearly(spark, d, *keys).withColumn("rate", rate(F.col("n_returned"), F.col("exposure")))


@register(f"""WITH c AS (SELECT o_custkey AS id, year(o_orderdate) AS season, o_orderpriority AS competition, sum(l_quantity) AS exposure, count(*) AS n_lines,
  count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), v AS (SELECT *, {_RETURNED} AS rate FROM c)
SELECT id, season, {_ROLL} FROM v GROUP BY id, season""")
def season_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Competition vectors to season vectors: rates become counts and are normalised anew."""
    return S.rolled_up(_vectors(spark, d, "o_orderpriority"), ["id", "season"], {"rate": "rate"}, "exposure", {"returned_pct": ("n_returned", "n_lines")}).withColumn("season", F.col("season").cast("long"))


@register(f"WITH {_YEARLY}, v AS (SELECT *, {_RETURNED} AS rate FROM yearly) SELECT id, {_ROLL} FROM v GROUP BY id")
def career_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Season vectors to a career vector (F16)."""
    return S.rolled_up(_vectors(spark, d), ["id"], {"rate": "rate"}, "exposure", {"returned_pct": ("n_returned", "n_lines")})


# Teams (M, F18-F21)

_TALL = "tall AS (SELECT id, team, cohort, n_orders, capability, score FROM scores UNPIVOT (score FOR capability IN (" + ", ".join(CAPABILITIES) + ")))"


def _tall(spark: SparkSession, d: str) -> DataFrame:
    return T.long_scores(entity_scores(spark, d), ["id", "team", "cohort", "n_orders"], CAPABILITIES)


@register(f"""WITH {SCORES}, {_TALL}, h AS (SELECT team, capability, coalesce({rnd('1e4 * sum(CASE WHEN score > 0 THEN score * score END) / (sum(CASE WHEN score > 0 THEN score END) * sum(CASE WHEN score > 0 THEN score END))', 4)}, 0e0) AS hhi FROM tall GROUP BY 1, 2)
SELECT *, hhi > 2500 AS over_centralised FROM h""")
def hhi(spark: SparkSession, d: str) -> DataFrame:
    """Concentration of capabilities in teams."""
    return T.concentration(_tall(spark, d), ["team"])


@register(f"""WITH {SCORES}, {_TALL}, s AS (SELECT team, capability, id, {rnd('coalesce(score * 100e0 / nullif(sum(score) OVER (PARTITION BY team, capability), 0e0), 0e0)', 4)} AS share FROM tall),
r AS (SELECT *, row_number() OVER (PARTITION BY team, capability ORDER BY share DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def dependency_shares(spark: SparkSession, d: str) -> DataFrame:
    """The members a team depends on most."""
    return T.shares(_tall(spark, d), ["team"], "id")


_MEANS = "means AS (SELECT team, count(*) AS squad_size, " + ", ".join(f"{rnd(f'avg({c})', 1)} AS {c}" for c in CAPABILITIES) + " FROM scores GROUP BY team)"


def _means(spark: SparkSession, d: str) -> DataFrame:
    return entity_scores(spark, d).groupBy("team").agg(F.count("*").alias("squad_size"), *[rounded(F.avg(c), 1).alias(c) for c in CAPABILITIES])


_BOTTLENECKS = [("progression", "threat"), ("creation", "threat"), ("defence", "security")]


@register(f"WITH {SCORES}, {_MEANS} " + " UNION ALL ".join(f"SELECT team, '{u}' AS upstream, '{v}' AS downstream, {rnd(f'{u} - {v}', 1)} AS severity FROM means WHERE {u} - {v} > 2" for u, v in _BOTTLENECKS))
def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    """Upstream capabilities far above downstream ones (M2)."""
    return T.bottlenecks(_means(spark, d), ["team"], _BOTTLENECKS, 2.0)


_MEAN6 = "(" + " + ".join(CAPABILITIES) + ") / 6e0"


@register(f"""WITH {SCORES}, {_MEANS}, ag AS (SELECT n_name AS team, {rnd("avg(CASE WHEN c_acctbal >= 0 THEN floor(datediff('day', b, TIMESTAMP '2000-01-01') / 365.25e0 * 10e0 + 0.5e0) / 10e0 END)", 6)} AS average_age
  FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT team, squad_size, {sql_bands(_MEAN6, S.GRADES, 'D')} AS grade, average_age FROM means JOIN ag USING (team)""")
def team_grade(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores, squad size, letter grade and the mean age of those whose age is known."""
    mean = sum((F.col(c) for c in CAPABILITIES), F.lit(0.0)) / 6
    born = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").alias("born"))
    members = table(spark, d, "customer").join(born, "c_custkey").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    known = F.when(F.col("c_acctbal") >= 0, age_years(F.col("born"), F.lit("2000-01-01").cast("date")))
    ages = members.groupBy(F.col("n_name").alias("team")).agg(rounded(F.avg(known), 6).alias("average_age"))
    return _means(spark, d).select("team", "squad_size", S.grade(mean).alias("grade")).join(ages, "team")


@register(f"""WITH {SCORES},
n AS (SELECT *, count(*) OVER (PARTITION BY team) AS n, {', '.join(f'(sum({c}) OVER (PARTITION BY team) - {c}) / nullif(count(*) OVER (PARTITION BY team) - 1, 0) AS r_{c}, avg({c}) OVER (PARTITION BY team) AS m_{c}' for c in CAPABILITIES)} FROM scores),
f AS (SELECT * FROM n WHERE n >= 2),
l AS (SELECT *, {' + '.join(f'greatest(sum_{c}, 0e0)' for c in CAPABILITIES)} AS lost FROM (SELECT *, {', '.join(f'(m_{c} - r_{c}) AS sum_{c}' for c in CAPABILITIES)} FROM f)),
c AS (SELECT l.team, l.id, l.lost, l.n, p.id AS cand, {' + '.join(f'CASE WHEN {rnd(f'l.sum_{c}', 9)} > 0 THEN p.{c} - l.r_{c} ELSE 0e0 END' for c in CAPABILITIES)} AS gain FROM l JOIN f p ON l.cohort = p.cohort AND l.id <> p.id),
b AS (SELECT team, id, any_value(lost) AS lost, any_value(n) AS n, max(gain) AS gain FROM c GROUP BY 1, 2),
d AS (SELECT team, id, lost, CASE WHEN {rnd('lost - greatest(0e0, coalesce(gain, 0e0) / n)', 4)} <= 0 THEN 0.1e0 ELSE lost - greatest(0e0, coalesce(gain, 0e0) / n) END AS deficit FROM l LEFT JOIN b USING (team, id, lost, n))
SELECT team, id, {rnd('lost', 4)} AS loss, {rnd('deficit', 4)} AS deficit FROM d""")
def fragility(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-out loss and best replacement without pairing members (M4). The SQL pairs them all."""
    return T.fragility(entity_scores(spark, d), "id", ["team"], "cohort", CAPABILITIES).select("team", "id", "loss", "deficit")


#: Z-profiles of the styles of play.
STYLES = {
    "Possession-Dominant": {"progression": 0.5, "creation": 0.5, "security": 1.5, "resistance": 1.0, "defence": -1.0, "threat": 0.0},
    "High Press": {"progression": 0.0, "creation": 0.0, "security": -0.5, "resistance": 0.5, "defence": 1.5, "threat": 0.0},
    "Direct and Progressive": {"progression": 1.5, "creation": 1.0, "security": -1.0, "resistance": 0.0, "defence": 0.0, "threat": 1.0},
    "Counter-Attacking": {"progression": 1.0, "creation": 0.5, "security": -1.5, "resistance": -0.5, "defence": 0.5, "threat": 1.5},
    "Defensive and Resilient": {"progression": -1.0, "creation": -1.0, "security": 0.5, "resistance": 0.0, "defence": 1.5, "threat": -1.0},
}
_Z = "z AS (SELECT team, " + ", ".join(f"{rnd(f'(avg({c}) - (SELECT avg({c}) FROM scores)) / (SELECT stddev_pop({c}) FROM scores)', 6)} AS z_{c}" for c in CAPABILITIES) + " FROM scores GROUP BY team)"
_STYLE_ROWS = " UNION ALL ".join(
    f"SELECT team, '{n}' AS style, {rnd('coalesce((' + ' + '.join(f'z_{c} * {float(v[c])}e0' for c in CAPABILITIES) + ') / nullif(sqrt(' + ' + '.join(f'z_{c} * z_{c}' for c in CAPABILITIES) + f') * {sum(x * x for x in v.values()) ** 0.5!r}, 0e0), 0e0)', 6)} AS similarity FROM z" for n, v in STYLES.items()
)


def _team_z(spark: SparkSession, d: str) -> DataFrame:
    s = entity_scores(spark, d)
    whole = s.agg(*[F.avg(c).alias(f"a_{c}") for c in CAPABILITIES], *[F.stddev_pop(c).alias(f"d_{c}") for c in CAPABILITIES])
    g = s.groupBy("team").agg(*[F.avg(c).alias(c) for c in CAPABILITIES]).crossJoin(F.broadcast(whole))  # one row
    return g.select("team", *[rounded((F.col(c) - F.col(f"a_{c}")) / F.when(F.col(f"d_{c}") == 0, 1.0).otherwise(F.col(f"d_{c}")), 6).alias(f"z_{c}") for c in CAPABILITIES])


@register(f"""WITH {SCORES}, {_Z}, s AS ({_STYLE_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY similarity DESC, style) AS k FROM s)
SELECT team, max(CASE WHEN k = 1 THEN CASE WHEN similarity > 0.6 THEN style ELSE 'Balanced' END END) AS primary_style, max(similarity) FILTER (WHERE k = 1) AS similarity,
  max(CASE WHEN k = 2 AND similarity > 0.75 THEN style END) AS secondary_style FROM r GROUP BY team""")
def identity(spark: SparkSession, d: str) -> DataFrame:
    """Style of a team by its z-vector (M5)."""
    return T.best_styles(_team_z(spark, d), ["team"], CAPABILITIES, STYLES)


def _sql_listed(keep: str, order: str = "-{}", names: list[str] = CAPABILITIES, k: int | None = None) -> str:
    """SQL of operators.teams.listed; {} stands for the score."""
    hits = ", ".join(f"CASE WHEN {keep.format(c)} THEN {{'o': CAST({order.format(c)} AS DOUBLE), 's': '{c}'}} END" for c in names)
    names = f"list_transform(list_sort(list_filter([{hits}], lambda x: x IS NOT NULL)), lambda x: x.s)"
    return f"array_to_string({names if k is None else f'{names}[1:{k}]'}, ',')"


@register(f"""WITH {SCORES}, {_MEANS} SELECT team, {rnd('threat + security', 1)} AS strength, {_sql_listed('{} >= 80')} AS strengths, {_sql_listed('{} <= 60')} AS weaknesses,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {c} > 50 THEN 'Elite {c.title()}' END" for c in CAPABILITIES)}], lambda x: x IS NOT NULL), ',') AS traits FROM means ORDER BY strength DESC, team LIMIT 5""")
def strongest_teams(spark: SparkSession, d: str) -> DataFrame:
    """The five strongest teams with strengths from 80 on, weaknesses up to 60, and traits (M5, M7, M8): a top-k report."""
    lists = [T.listed(CAPABILITIES, lambda c: c >= 80).alias("strengths"), T.listed(CAPABILITIES, lambda c: c <= 60).alias("weaknesses"), T.emergent_traits(CAPABILITIES, 50.0).alias("traits")]
    return _means(spark, d).select("team", rounded(F.col("threat") + F.col("security"), 1).alias("strength"), *lists).orderBy(F.desc("strength"), "team").limit(5)


# Decisions (N)

@register(f"""WITH {SCORES}, {_TALL}, c AS (SELECT id, capability, score, {rnd('(rank() OVER (PARTITION BY cohort, capability ORDER BY score) - 1) * 1e0 / count(*) OVER (PARTITION BY cohort, capability) * 100e0')} AS pct,
  row_number() OVER (PARTITION BY id ORDER BY score DESC, capability) AS k FROM tall)
SELECT id, string_agg(capability, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top, string_agg(capability, ',' ORDER BY k DESC) FILTER (WHERE k > 3) AS bottom,
  coalesce(string_agg(capability || ' ' || CASE WHEN score >= 80 THEN 'elite' WHEN score >= 70 THEN 'excellent' ELSE 'limited' END, ',' ORDER BY k) FILTER (WHERE score >= 70 OR score <= 40), '') AS bands,
  string_agg(capability || ' ' || CAST(CAST(pct AS BIGINT) AS VARCHAR) || 'th percentile', ',' ORDER BY capability) AS explained, count(*) FILTER (WHERE pct >= 85) AS n_elite, count(*) FILTER (WHERE pct <= 35) AS n_weak FROM c GROUP BY id""")
def decision_card(spark: SparkSession, d: str) -> DataFrame:
    """Elite and weak traits against the cohort, the three best and worst, bands and percentiles as text."""
    t = K.below_percentile(_tall(spark, d), ["cohort", "capability"], "score", "pct")
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "capability")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "capability")))), lambda x: x["capability"]), ",")
    texts = lambda keep, order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), text.alias("t"))))), lambda x: x["t"]), ",")
    bottom = texts(F.col("k") > 3, -F.col("k"), F.col("capability"))
    banded = texts((F.col("score") >= 70) | (F.col("score") <= 40), F.col("k"), F.concat_ws(" ", "capability", S.strength_band(F.col("score"))))
    explained = texts(F.lit(True), F.col("capability"), F.concat("capability", F.lit(" "), F.col("pct").cast("long").cast("string"), F.lit("th percentile")))
    return t.groupBy("id").agg(top.alias("top"), bottom.alias("bottom"), banded.alias("bands"), explained.alias("explained"), F.count_if(F.col("pct") >= 85).alias("n_elite"), F.count_if(F.col("pct") <= 35).alias("n_weak"))


_TO_MEDIAN = rnd("{0} - (SELECT median({0}) FROM means)", 4)
_GAPS_UP, _GAPS_DOWN = _sql_listed(f"{_TO_MEDIAN} > 0", f"-{_TO_MEDIAN}", k=3), _sql_listed(f"{_TO_MEDIAN} < 0", _TO_MEDIAN, k=3)


@register(f"WITH {SCORES}, {_MEANS} SELECT team, " + ", ".join(f"{rnd(f'{c} - (SELECT quantile_cont({c}, 0.75) FROM means)', 4)} AS {c}_gap" for c in CAPABILITIES) + ", " + rnd("threat - (SELECT median(threat) FROM means)", 4) + f" AS threat_to_median, {_GAPS_UP} AS strengths, {_GAPS_DOWN} AS weaknesses FROM means")
def gap_to_quartile(spark: SparkSession, d: str) -> DataFrame:
    """Distance of a team to the cohort's upper quartile and median, and the three largest gaps either way."""
    m = _means(spark, d)
    q = m.agg(*[F.percentile(c, 0.75).alias(f"q_{c}") for c in CAPABILITIES], *[F.percentile(c, 0.5).alias(f"m_{c}") for c in CAPABILITIES])
    j = m.crossJoin(F.broadcast(q))  # one row
    gaps = j.select("team", *[rounded(F.col(c) - F.col(f"q_{c}"), 4).alias(f"{c}_gap") for c in CAPABILITIES], *[rounded(F.col(c) - F.col(f"m_{c}"), 4).alias(c) for c in CAPABILITIES])
    lists = [T.listed(CAPABILITIES, lambda c: c > 0, k=3).alias("strengths"), T.listed(CAPABILITIES, lambda c: c < 0, CAPABILITIES, 3).alias("weaknesses")]
    return gaps.select("team", *[f"{c}_gap" for c in CAPABILITIES], F.col("threat").alias("threat_to_median"), *lists)


@register(f"""WITH {SCORES}, x AS (SELECT id, team, threat, avg(threat) OVER w AS before, (sum(threat) OVER w - threat) / nullif(count(*) OVER w - 1, 0) AS after FROM scores WINDOW w AS (PARTITION BY team))
SELECT id, team, {rnd('after - before', 4)} AS delta, {rnd('after / nullif(before, 0e0) * 100e0', 2)} AS retained_pct FROM x WHERE after IS NOT NULL""")
def counterfactual_removal(spark: SparkSession, d: str) -> DataFrame:
    """A team without each member."""
    x = entity_scores(spark, d).select("id", "team", F.avg("threat").over(Window.partitionBy("team")).alias("before"), T.leave_one_out("threat", ["team"]).alias("after")).where("after IS NOT NULL")
    return x.select("id", "team", rounded(F.col("after") - F.col("before"), 4).alias("delta"), rounded(F.col("after") / F.nullif(F.col("before"), F.lit(0.0)) * 100.0, 2).alias("retained_pct"))


@register(f"""WITH {SCORES}, t AS (SELECT team, sum(threat) AS s, count(*) AS n FROM scores GROUP BY team), b AS (SELECT * FROM scores ORDER BY threat DESC, id LIMIT 1)
SELECT t.team, {rnd('(s + b.threat) / (n + 1) - s / n', 4)} AS delta FROM t, b WHERE t.team <> b.team""")
def counterfactual_addition(spark: SparkSession, d: str) -> DataFrame:
    """Each other team with the best member of all."""
    s = entity_scores(spark, d)
    best = s.orderBy(F.desc("threat"), "id").limit(1).select(F.col("threat").alias("bt"), F.col("team").alias("own"))
    t = s.groupBy("team").agg(F.sum("threat").alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(best)).where("team <> own")
    return t.select("team", rounded(T.with_added(F.col("s"), F.col("n"), F.col("bt")) - F.col("s") / F.col("n"), 4).alias("delta"))


@register(f"""WITH {SCORES}, {_TALL} SELECT cohort, capability, min(score) AS low, max(score) AS high, count(*) AS n, arg_max(id, (score, -id)) AS best, arg_min(id, (score, id)) AS worst,
  min(score) >= 70 AS shared_strength, max(score) - min(score) > 15 AS key_difference,
  capability || CASE WHEN min(score) >= 70 THEN ': shared strength' WHEN max(score) - min(score) > 15 THEN ': ' || CAST(arg_max(id, (score, -id)) AS VARCHAR) || ' leads ' || CAST(arg_min(id, (score, id)) AS VARCHAR) ELSE ': alike' END AS summary FROM tall GROUP BY 1, 2""")
def compare_group(spark: SparkSession, d: str) -> DataFrame:
    """Shared strengths and key differences of whole groups of entities, with a summary."""
    c = D.comparison(_tall(spark, d), ["cohort"], "id")
    gap = F.concat(F.lit(": "), F.col("best").cast("string"), F.lit(" leads "), F.col("worst").cast("string"))
    return c.withColumn("summary", F.concat("capability", F.when(F.col("shared_strength"), ": shared strength").when(F.col("key_difference"), gap).otherwise(": alike")))


_ASKED = D.criteria({"creation": 1.0, "threat": 1.5}, ["Goalscoring", "Chance Creation"], {"security": 0.5, "defence": 0.0})
_WEIGHT = sum(_ASKED.values())
_FIT = rnd(f"({sql_sum(D.STYLE_WEIGHTS['High Press'])}) * 0.4e0 + 50e0 * 0.2e0 + 50e0 * 0.2e0 + 50e0 * 0.1e0 + 50e0 * 0.1e0", 1)


@register(f"""WITH {SCORES}, c AS (SELECT id, {rnd(f'({sql_sum(_ASKED)}) / {_WEIGHT}e0 * 0.7e0 + {_FIT} * 0.3e0', 6)} AS fit_score,
  CASE WHEN exposure > 1800 THEN 'high' WHEN exposure < 900 THEN 'low' ELSE 'medium' END AS confidence FROM scores WHERE cohort IN ('BUILDING', 'MACHINERY') AND exposure >= 100)
SELECT *, CASE WHEN fit_score > 85 THEN 'Excellent Fit' WHEN fit_score > 70 THEN 'Strong Fit' ELSE 'Good Fit' END AS band, row_number() OVER (ORDER BY fit_score DESC, id) AS rank FROM c ORDER BY fit_score DESC, id LIMIT 10""")
def rank_by_criteria(spark: SparkSession, d: str) -> DataFrame:
    """The ten best by built criteria and style, with their band (N7, N13): a top-k report."""
    fit = D.overall_fit(D.alignment("High Press"), F.lit(50.0))
    best = D.rank_candidates(entity_scores(spark, d), "id", _ASKED, fit=fit, where=F.col("cohort").isin("BUILDING", "MACHINERY") & (F.col("exposure") >= 100))
    return best.select("id", "fit_score", D.confidence_by_minutes(F.col("exposure")).alias("confidence"), D.star_band(F.col("fit_score")).alias("band"), "rank")


_PAIR_DIST = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in CAPABILITIES) + ")"
_RESTORE = lambda test: " + ".join(f"CASE WHEN a.{c} > 0 AND b.{c} * 100e0 / a.{c} {test} THEN 1 ELSE 0 END" for c in CAPABILITIES)


_RESTORED = " + ".join(f"CASE WHEN a.{c} > 0 THEN least(b.{c} * 100e0 / a.{c}, 100e0) ELSE 0e0 END" for c in CAPABILITIES)
_ABOVE = " + ".join(f"CASE WHEN a.{c} > 0 THEN 1 ELSE 0 END" for c in CAPABILITIES)


@register(f"""WITH {SCORES}, p AS (SELECT a.id, b.id AS candidate, {rnd(f'greatest(0e0, least(100e0, (1e0 - {_PAIR_DIST} / 245e0) * 100e0))', 6)} AS fit_score,
  CAST({_RESTORE('> 110')} AS BIGINT) AS enhanced, CAST({_RESTORE('< 85')} AS BIGINT) AS reduced, {rnd(f'({_RESTORED}) / nullif({_ABOVE}, 0)', 4)} AS restored_pct
  FROM scores a JOIN scores b ON a.cohort = b.cohort AND a.id <> b.id AND a.team <> b.team WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fit_score DESC, candidate) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""")
def replacements(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest replacements of each entity whose id is divisible by 100, out of all."""
    return D.replacements(entity_scores(spark, d), "id", "cohort", "team", CAPABILITIES, asked=F.col("id") % 100 == 0)


@register(f"""WITH {SCORES}, p AS (SELECT a.id, b.id AS candidate, {rnd(f'greatest(0e0, least(100e0, (1e0 - {_PAIR_DIST} / 245e0) * 100e0))', 6)} AS similarity FROM scores a JOIN scores b ON a.cohort = b.cohort AND a.id <> b.id WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, candidate) AS rank FROM p WHERE similarity >= 60) SELECT * FROM r WHERE rank <= 3""")
def similar_topn(spark: SparkSession, d: str) -> DataFrame:
    """For each entity whose id is divisible by 100 the most similar of all in its cohort, from similarity 60 on."""
    return _similar(spark, d, F.col("id") % 100 == 0)


def _similar(spark: SparkSession, d: str, asked=None) -> DataFrame:
    found = neighbours(entity_scores(spark, d), "id", "cohort", CAPABILITIES, 3, D.fit_of, reach=D.MAX_DISTANCE * 0.4 + 1e-4, asked=asked)
    return found.ranked.where("score >= 60").select("id", "candidate", F.col("score").alias("similarity"), "rank")


@register(f"""WITH {SCORES}, p AS (SELECT a.id, b.id AS candidate, {rnd(f'greatest(0e0, least(100e0, (1e0 - {_PAIR_DIST} / 245e0) * 100e0))', 6)} AS similarity FROM scores a JOIN scores b ON a.cohort = b.cohort AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, candidate) AS rank FROM p WHERE similarity >= 60)
SELECT 'P' || id AS source, 'P' || candidate AS target, 'SIMILAR_TO' AS edge_type, {rnd('similarity / 100e0', 6)} AS weight, rank FROM r WHERE rank <= 3""")
def similar_edges(spark: SparkSession, d: str) -> DataFrame:
    """SIMILAR_TO edges of every entity: its three most similar of all in its cohort, by pivots."""
    return _edges(_similar(spark, d), "SIMILAR_TO", "similarity")


@register(f"""WITH {SCORES}, p AS (SELECT a.id, b.id AS candidate, {rnd(f'greatest(0e0, least(100e0, (1e0 - {_PAIR_DIST} / 245e0) * 100e0))', 6)} AS fit_score FROM scores a JOIN scores b ON a.cohort = b.cohort AND a.id <> b.id AND a.team <> b.team),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fit_score DESC, candidate) AS rank FROM p)
SELECT 'P' || candidate AS source, 'P' || id AS target, 'REPLACEMENT_FOR' AS edge_type, {rnd('fit_score / 100e0', 6)} AS weight, rank FROM r WHERE rank <= 5""")
def replacement_edges(spark: SparkSession, d: str) -> DataFrame:
    """REPLACEMENT_FOR edges to every entity from its five nearest of the cohort in other teams."""
    found = neighbours(entity_scores(spark, d), "id", "cohort", CAPABILITIES, 5, D.fit_of, apart="team").ranked
    turned = found.select(F.col("candidate").alias("id"), F.col("id").alias("candidate"), "score", "rank")
    return _edges(turned, "REPLACEMENT_FOR", "score")


def _edges(pairs: DataFrame, kind: str, percent: str) -> DataFrame:
    node = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    return pairs.select(node("id").alias("source"), node("candidate").alias("target"), F.lit(kind).alias("edge_type"), rounded(F.col(percent) / 100, 6).alias("weight"), "rank")


_WEAK = " + ".join(f"CASE WHEN m.{c} < {D.WEAK} THEN 1 ELSE 0 END" for c in CAPABILITIES)
_RELIEF = f"CASE WHEN {_WEAK} > 0 THEN (" + " + ".join(f"CASE WHEN m.{c} < {D.WEAK} THEN s.{c} ELSE 0e0 END" for c in CAPABILITIES) + f") / ({_WEAK}) ELSE 50e0 END"
_ALIGN = "CASE z.primary_style " + " ".join(f"WHEN '{n}' THEN {' + '.join(f's.{k} * {v}e0' for k, v in w.items())}" for n, w in D.STYLE_WEIGHTS.items()) + " END"


@register(f"""WITH {SCORES}, {_MEANS}, {_Z}, st AS ({_STYLE_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY similarity DESC, style) AS k FROM st),
z1 AS (SELECT team, CASE WHEN similarity > 0.6 THEN style ELSE 'Balanced' END AS primary_style FROM r WHERE k = 1), att AS ({ORACLES['versatility']}),
f AS (SELECT s.id, z.primary_style, {rnd(f'({_ALIGN}) * 0.4e0 + 50e0 * 0.2e0 + ({_RELIEF}) * 0.2e0 + a.versatility * 0.1e0 + a.availability * 0.1e0', 1)} AS overall FROM scores s JOIN means m ON s.team = m.team JOIN z1 z ON s.team = z.team JOIN att a ON a.id = s.id)
SELECT *, {sql_bands('overall', D.FIT_LABELS, 'Poor')} AS label FROM f""")
def tactical_fit(spark: SparkSession, d: str) -> DataFrame:
    """Fit of each member to its team's own style and weaknesses, with its versatility and availability."""
    means = _means(spark, d).select("team", *[F.col(c).alias(f"m_{c}") for c in CAPABILITIES])
    style = T.best_styles(_team_z(spark, d), ["team"], CAPABILITIES, STYLES).select("team", "primary_style")
    j = entity_scores(spark, d).join(means, "team").join(style, "team").join(versatility(spark, d), "id")
    aligned = None
    for n in D.STYLE_WEIGHTS:
        hit = F.col("primary_style") == n
        aligned = F.when(hit, D.alignment(n)) if aligned is None else aligned.when(hit, D.alignment(n))
    relief = D.relief({c: F.col(f"m_{c}") < D.WEAK for c in CAPABILITIES}, CAPABILITIES)
    out = j.select("id", "primary_style", D.overall_fit(aligned, relief, adaptable=F.col("versatility"), available=F.col("availability")).alias("overall"))
    return out.withColumn("label", D.fit_label(F.col("overall")))


@register(f"""WITH {SCORES} SELECT id, array_to_string(list_filter([CASE WHEN threat >= 80 THEN 'Strong threat' END, CASE WHEN creation >= 80 THEN 'Strong creation' END, CASE WHEN n_orders >= 15 THEN 'Reliable' END], lambda x: x IS NOT NULL), ',') AS strengths,
  array_to_string(list_filter([CASE WHEN threat < 50 THEN 'Limited threat' END, CASE WHEN creation < 50 THEN 'Limited creation' END, CASE WHEN n_orders < 5 THEN 'Small sample' END], lambda x: x IS NOT NULL), ',') AS trade_offs FROM scores""")
def trade_offs(spark: SparkSession, d: str) -> DataFrame:
    """Strengths and weaknesses as text."""
    plus = [("Strong threat", F.col("threat") >= 80), ("Strong creation", F.col("creation") >= 80), ("Reliable", F.col("n_orders") >= 15)]
    minus = [("Limited threat", F.col("threat") < 50), ("Limited creation", F.col("creation") < 50), ("Small sample", F.col("n_orders") < 5)]
    return entity_scores(spark, d).select("id", F.array_join(S.signals(plus), ",").alias("strengths"), F.array_join(S.signals(minus), ",").alias("trade_offs"))


@register(f"""WITH {SCORES}, a AS (SELECT id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY threat DESC, id) AS actual, row_number() OVER (PARTITION BY cohort ORDER BY exposure DESC, id) AS expected, count(*) OVER (PARTITION BY cohort) AS n FROM scores)
SELECT id, actual, expected, abs(actual - expected) > n / 2e0 AS inverted FROM a""")
def ranking_inversions(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose rank is far from the expected one."""
    s = entity_scores(spark, d).select("id", "cohort", "threat", "exposure")
    a = K.numbered(s, ["cohort"], [F.desc("threat"), F.col("id")], "actual")
    a = K.numbered(a.drop("__n"), ["cohort"], [F.desc("exposure"), F.col("id")], "expected", "n")
    return a.select("id", "actual", "expected", (F.abs(F.col("actual") - F.col("expected")) > F.col("n") / 2).alias("inverted"))


@register(f"""WITH {SCORES}, {_T_SQL}, s AS (SELECT id, template, {_SIM} AS similarity FROM scores, t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, template) AS k FROM s),
g AS (SELECT CASE WHEN similarity < 0.3e0 THEN 'Unknown' ELSE template END AS template, count(*) AS n FROM r WHERE k = 1 GROUP BY 1), {_TALL}, b AS (SELECT capability, id, row_number() OVER (PARTITION BY capability ORDER BY score DESC, id) AS k FROM tall)
SELECT 'template' AS part, template AS name, n, {rnd('n * 100e0 / (SELECT sum(n) FROM g)', 2)} AS share_pct, NULL AS best FROM g UNION ALL SELECT 'capability', capability, count(*), NULL, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5) FROM b GROUP BY capability""")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the best templates, the unknown among them, and the five best of each capability."""
    g = archetype_match(spark, d).where("rank = 1").groupBy("template").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    shares = g.crossJoin(F.broadcast(total)).select(F.lit("template").alias("part"), F.col("template").alias("name"), "n", rounded(F.col("n") * 100.0 / F.col("t"), 2).alias("share_pct"), F.lit(None).cast("string").alias("best"))  # one row
    tall = _tall(spark, d)
    top = K.top_k(tall, ["capability"], [F.desc("score"), F.col("id")], 5).groupBy("capability").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("b"))
    counts = tall.groupBy("capability").agg(F.count("*").alias("n")).join(top, "capability")
    best = F.array_join(F.transform("b", lambda x: x["id"].cast("string")), ",")
    return shares.unionByName(counts.select(F.lit("capability").alias("part"), F.col("capability").alias("name"), "n", F.lit(None).cast("double").alias("share_pct"), best.alias("best")))
