"""Explanation contexts of players, teams, comparisons and recruitment, and their faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.scalar import rounded
from cohortry.operators import cohort as K
from cohortry.operators import contexts as X
from cohortry.operators import decisions as D
from cohortry.operators import scoring as S
from cohortry.operators import teams as T

from .base import CAPABILITIES, SCORES, entity_scores, rnd
from .score_queries import _BOTTLENECKS, _MEANS, _PAIR_DIST, _STYLE_ROWS, _TALL, _Z, ORACLES as SCORE_SQL
from .score_queries import STYLES, _means, _similar, _tall, _team_z

QUERIES, ORACLES = {}, {}


def register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


#: Signals of the stand-in entities: name, capability, least score.
_SIGNALS = [("Threat", "threat", 85), ("press_monster", "defence", 85), ("security", "security", 90)]
_REQUIRED = {"threat": 0.5, "creation": 0.3, "progression": 0.2}


def _signals() -> Column:
    return S.signals([(name, F.col(c) >= least) for name, c, least in _SIGNALS])


def _players(spark: SparkSession, d: str) -> DataFrame:
    s = entity_scores(spark, d)
    return X.player_contexts(s, CAPABILITIES, K.confidence(F.col("n_orders")), _signals(), ["id", "name", "team", "cohort"])


def _said(faults: Column) -> Column:
    return F.array_join(faults, ",").alias("faults")


_SQL_SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN {c} >= {least} THEN '{name}' END" for name, c, least in _SIGNALS) + "], lambda x: x IS NOT NULL)"
_SQL_OWN = " || ';' || ".join(
    f"'{c}=' || array_to_string(CASE WHEN len(list_filter(g, lambda x: contains('{c}', lower(x)))) > 0 THEN list_filter(g, lambda x: contains('{c}', lower(x))) WHEN {c} > 80 THEN g ELSE [] END, '+')" for c in CAPABILITIES
)


@register(f"""WITH {SCORES}, g AS (SELECT *, {_SQL_SIGNALS} AS g FROM scores) SELECT id, name, {_SQL_OWN} AS signals, {rnd(' + '.join(CAPABILITIES), 4)} AS total, CAST(6 AS BIGINT) AS n_packets, least(1e0, n_orders / 10e0) AS overall_confidence, '' AS faults FROM g""")
def player_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context for each entity: a packet for each capability with its metrics and related signals."""
    p = _players(spark, d)
    signals = F.array_join(F.transform("packets", lambda x: F.concat(F.replace(x["source"], F.lit("capability:"), F.lit("")), F.lit("="), F.array_join(x["signals"], "+"))), ";")
    total = F.aggregate("packets", F.lit(0.0), lambda a, x: a + x["metrics"][0]["raw_value"])
    return p.select("id", "name", signals.alias("signals"), rounded(total, 4).alias("total"), F.size("packets").cast("long").alias("n_packets"), "overall_confidence", _said(X.player_faults(F.col("name"), F.col("packets"), F.col("overall_confidence"))))


_RULES = "[" + ", ".join(f"CASE WHEN {u} - {v} > 2 THEN {{'o': -{rnd(f'{u} - {v}', 1)}, 'u': '{u}', 'v': '{v}'}} END" for u, v in _BOTTLENECKS) + "]"


@register(f"""WITH {SCORES}, {_TALL}, {_MEANS}, {_Z}, st AS ({_STYLE_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY similarity DESC, style) AS k FROM st),
y AS (SELECT team, CASE WHEN similarity > 0.6 THEN style ELSE 'Balanced' END AS style FROM r WHERE k = 1),
h AS ({SCORE_SQL['hhi'].split(', h AS (')[1].split(')\nSELECT')[0]}),
hh AS (SELECT team, string_agg(capability, ',' ORDER BY capability) AS risks FROM h WHERE hhi > 2500 GROUP BY 1),
fr AS ({SCORE_SQL['fragility']}),
fk AS (SELECT team, string_agg(CAST(id AS VARCHAR) || ' ' || name, ',' ORDER BY k) AS fragilities FROM (SELECT fr.team, id, name, row_number() OVER (PARTITION BY fr.team ORDER BY deficit DESC, id) AS k FROM fr JOIN scores USING (id)) WHERE k <= 3 GROUP BY 1)
SELECT means.team, squad_size, style, coalesce(risks, '') AS risks, array_to_string(list_transform(list_sort(list_filter({_RULES}, lambda x: x IS NOT NULL)), lambda x: x.u || '>' || x.v), ',') AS bottlenecks,
  coalesce(fragilities, '') AS fragilities, CAST(6 AS BIGINT) AS n_packets, '' AS faults FROM means JOIN y USING (team) LEFT JOIN hh USING (team) LEFT JOIN fk USING (team)""")
def team_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context for each team: style, risks, bottlenecks, the three most fragile members, packets."""
    s, means = entity_scores(spark, d), _means(spark, d)
    styles = T.best_styles(_team_z(spark, d), ["team"], CAPABILITIES, STYLES).select("team", "primary_style")
    fragile = T.fragility(s, "id", ["team"], "cohort", CAPABILITIES).select("team", "id", "loss", "deficit").join(s.select("id", "name"), "id")
    c = X.team_contexts(means, "team", CAPABILITIES, styles, T.concentration(_tall(spark, d), ["team"]), T.bottlenecks(means, ["team"], _BOTTLENECKS, 2.0), fragile, "id", "name")
    pairs = F.transform("bottlenecks", lambda b: F.concat(b["upstream"], F.lit(">"), b["downstream"]))
    people = F.transform("fragilities", lambda f: F.concat(f["id"].cast("string"), F.lit(" "), f["name"]))
    return c.select("team", "squad_size", "style", F.array_join("risks.capability", ",").alias("risks"), F.array_join(pairs, ",").alias("bottlenecks"), F.array_join(people, ",").alias("fragilities"), F.size("packets").cast("long").alias("n_packets"), _said(X.team_faults(F.col("team"))))


_both = lambda test: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test.format(c)} THEN '{c}' END" for c in CAPABILITIES) + "], lambda x: x IS NOT NULL), ',')"


@register(f"""WITH {SCORES}, p AS (SELECT a.id, b.id AS other, {rnd(f'greatest(0e0, least(100e0, (1e0 - {_PAIR_DIST} / 245e0) * 100e0))', 6)} AS similarity FROM scores a JOIN scores b ON a.cohort = b.cohort AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS k FROM p WHERE similarity >= 60)
SELECT a.id, r.other, {_both('least(a.{0}, b.{0}) >= 70')} AS shared_strengths, {_both('abs(a.{0} - b.{0}) > 15')} AS key_differences, a.name || CASE WHEN b.name IS NULL THEN '' ELSE ',' || b.name END AS players, CASE WHEN b.id IS NULL THEN 'players' ELSE '' END AS faults
FROM scores a LEFT JOIN r ON r.id = a.id AND k = 1 LEFT JOIN scores b ON b.id = r.other""")
def comparison_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context for each entity and the most similar one, with both players' contexts inside."""
    s = entity_scores(spark, d)
    nearest = _similar(spark, d).where("rank = 1").select("id", F.col("candidate").alias("other"))
    c = X.comparison_contexts(s.select("id").join(nearest, "id", "left"), "id", "other", _players(spark, d), s, CAPABILITIES)
    joined = lambda x: F.array_join(x, ",").alias(x)
    return c.select("id", "other", joined("shared_strengths"), joined("key_differences"), F.array_join("players.name", ",").alias("players"), _said(X.comparison_faults("name")))


_FIT = rnd(" + ".join(f"{c} * {w}e0" for c, w in _REQUIRED.items()), 6)
_LIST = lambda test: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} {test} THEN '{c}' END" for c in _REQUIRED) + "], lambda x: x IS NOT NULL), '+')"


@register(f"""WITH {SCORES}, f AS (SELECT cohort, name, {_FIT} AS fit, {_LIST('>= 80')} AS plus, {_LIST('< 50')} AS minus FROM scores),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY fit DESC, name) AS k FROM f)
SELECT cohort, string_agg(name || ' ' || plus || '/' || minus, ',' ORDER BY k) AS candidates, 'threat,creation,progression' AS required, '' AS faults FROM r WHERE k <= 10 GROUP BY 1""")
def recruitment_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context for each cohort: its ten best candidates with fit, strengths and trade-offs (P16, C13): a top-k report."""
    s = entity_scores(spark, d).withColumn("fit_score", rounded(D.base_score(_REQUIRED), 6))
    c = X.recruitment_contexts(s.select("cohort"), "cohort", s, "name", _REQUIRED, "Balanced", 10)
    each = F.transform("candidates", lambda x: F.concat(x["player_name"], F.lit(" "), F.array_join(x["strengths"], "+"), F.lit("/"), F.array_join(x["trade_offs"], "+")))
    return c.select("cohort", F.array_join(each, ",").alias("candidates"), F.array_join("required", ",").alias("required"), _said(X.recruitment_faults(F.col("cohort"))))
