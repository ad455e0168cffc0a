"""Graph, claims, text, data-quality and evaluation queries over the star schema and the conversations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import folded_name, rounded, short_id, title
from cohortry.operators import claims as C
from cohortry.operators import decisions as D
from cohortry.operators import dialogue as L
from cohortry.operators import evidence as E
from cohortry.operators import graph as G
from cohortry.operators import quality as Q
from cohortry.operators import teams as T
from cohortry.operators import text as X
from cohortry.sources.tables import changed_partitions, content_fingerprint, new_folder, save_reported, stored, written

from .base import CAPABILITIES, SCORES, entity_facts, entity_scores, rnd, table
from .score_queries import _MEANS, _TALL, _means, _tall, sql_bands

QUERIES, ORACLES = {}, {}


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Graph (O)

_NODES = """nodes AS (SELECT 'customer' AS node_type, CAST(c_custkey AS VARCHAR) AS node_id, c_name AS name FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'nation', n_name, n_name FROM nation UNION ALL SELECT 'region', r_name, r_name FROM region)"""
_EDGES = f"""edges AS (SELECT 'customer' AS source_type, CAST(id AS VARCHAR) AS source_id, 'capability' AS target_type, capability AS target_id, 'HAS_CAPABILITY' AS edge_type, {rnd('score / 100e0', 6)} AS weight FROM tall
UNION ALL SELECT 'customer', CAST(id AS VARCHAR), 'nation', team, 'MEMBER_OF', 1e0 FROM scores
UNION ALL SELECT 'nation', n_name, 'region', r_name, 'PART_OF', 1e0 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', n_name, 'MEMBER_OF', 1e0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'customer', CAST(id AS VARCHAR), 'signal', 'elite_goal_scorer', 'TRIGGERS', 1e0 FROM scores WHERE threat >= 85)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    kinds = [("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("nation", "nation", "n_name", "n_name"), ("region", "region", "r_name", "r_name")]
    return G.union_all([G.nodes(table(spark, d, t), kind, key, name) for kind, t, key, name in kinds])


def _edges(spark: SparkSession, d: str, types: list[str] | None = None) -> DataFrame:
    """Edges of all types, or of those asked for: what no asked type needs isn't computed."""
    n = table(spark, d, "nation")
    members = lambda: entity_facts(spark, d) if types is not None and not {"HAS_CAPABILITY", "TRIGGERS"} & set(types) else entity_scores(spark, d)
    places = lambda: n.join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = lambda: table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    elite = lambda: entity_scores(spark, d).where("threat >= 85").withColumn("signal", F.lit("elite_goal_scorer")).dropDuplicates(["id", "signal"])
    parts = [
        ("HAS_CAPABILITY", lambda: _tall(spark, d), ("customer", "id"), ("capability", "capability"), rounded(F.col("score") / 100.0, 6)),
        ("MEMBER_OF", members, ("customer", "id"), ("nation", "team"), None),
        ("PART_OF", places, ("nation", "n_name"), ("region", "r_name"), None),
        ("MEMBER_OF", suppliers, ("supplier", "s_suppkey"), ("nation", "n_name"), None),
        ("TRIGGERS", elite, ("customer", "id"), ("signal", "signal"), None),
    ]
    return G.union_all([G.edges(frame(), kind, source, target, weight) for kind, frame, source, target, weight in parts if types is None or kind in types])


@register(f"WITH {_NODES} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all types."""
    return _nodes(spark, d)


@register(f"WITH {SCORES}, {_TALL}, {_EDGES} SELECT * FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all types."""
    return _edges(spark, d)


@register(f"WITH {SCORES}, {_TALL}, {_NODES}, {_EDGES} SELECT 'node' AS part, node_type AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type."""
    return G.summary(_nodes(spark, d), _edges(spark, d))


@register(f"""WITH {SCORES}, {_TALL}, {_EDGES} SELECT s.node_id || '>' || a.target_id || '>' || b.target_id AS path, CAST(2 AS BIGINT) AS hops FROM (SELECT CAST(c_custkey AS VARCHAR) AS node_id FROM customer) s
JOIN (SELECT DISTINCT source_id, target_id FROM edges WHERE source_type = 'customer' AND edge_type = 'MEMBER_OF') a ON a.source_id = node_id JOIN (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'PART_OF') b ON b.source_id = a.target_id""")
def two_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two edges from every customer."""
    e = _edges(spark, d, ["MEMBER_OF", "PART_OF"]).where("source_type IN ('customer', 'nation')")
    paths = G.traverse(e, table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), None, 2)
    return paths.where("hops = 2").select(F.array_join("path", ">").alias("path"), "hops")


@register(f"""WITH {SCORES}, {_TALL}, {_NODES}, {_EDGES}, one AS (SELECT DISTINCT source_type || ':' || source_id AS s, target_type || ':' || target_id AS t FROM edges WHERE edge_type IN ('MEMBER_OF', 'PART_OF')),
p AS (SELECT a.s AS source, b.t AS target, a.t AS via FROM one a JOIN one b ON a.t = b.s WHERE b.t <> a.s), k AS (SELECT node_type || ':' || node_id AS node, name FROM nodes)
SELECT source, target, x.name || ' > ' || y.name || ' > ' || z.name AS names, CAST(2 AS BIGINT) AS hops FROM p JOIN k x ON x.node = source JOIN k y ON y.node = via JOIN k z ON z.node = target""")
def named_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two edges from every member over a stored adjacency, with the names of their nodes."""
    adjacency = G.adjacency(_edges(spark, d, ["MEMBER_OF", "PART_OF"]))
    start = adjacency.select("source").distinct()
    found = G.walk(adjacency, start, 2).where("hops = 2")
    named = G.with_names(found, _nodes(spark, d))
    return named.select(F.col("path")[0].alias("source"), F.element_at("path", -1).alias("target"), F.array_join("names", " > ").alias("names"), "hops")


@register(f"""WITH {SCORES}, {_TALL}, {_NODES}, {_EDGES} SELECT 'nodes' AS output, node_type AS kind, count(*) AS n, CAST(NULL AS VARCHAR) AS warning FROM nodes GROUP BY 2
UNION ALL SELECT 'edges', edge_type, count(*), NULL FROM edges GROUP BY 2 UNION ALL SELECT 'edges', edge_type, 0, 'declared, but not built' FROM (VALUES ('HAS_CAPABILITY'), ('MEMBER_OF'), ('PART_OF'), ('TRIGGERS'), ('FRAGILE_ON'), ('SIMILAR_TO')) t(edge_type) WHERE edge_type NOT IN (SELECT edge_type FROM edges)""")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the graph's build wrote, by output and kind, counted while they were written, and what the registry
    misses (A6, A10, O12)."""
    folder = new_folder(spark)
    nodes = save_reported(_nodes(spark, d), f"{folder}/nodes", "node_type", ["customer", "supplier", "nation", "region"])
    edges = save_reported(_edges(spark, d), f"{folder}/edges", "edge_type", DECLARED)
    rows = [("nodes", k, n, None) for k, n in nodes.items() if n] + [("edges", k, n, None if n else "declared, but not built") for k, n in edges.items()]
    return spark.createDataFrame(rows, "output string, kind string, n long, warning string")


#: Edge types of the graph, built or not.
DECLARED = ["HAS_CAPABILITY", "MEMBER_OF", "PART_OF", "TRIGGERS", "FRAGILE_ON", "SIMILAR_TO"]


@register(f"WITH {SCORES}, {_TALL}, {_EDGES} SELECT edge_type FROM (VALUES " + ", ".join(f"('{x}')" for x in DECLARED) + ") t(edge_type) WHERE edge_type NOT IN (SELECT edge_type FROM edges)")
def registry_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Declared edge types without an edge."""
    return G.missing_types(spark.createDataFrame([(x,) for x in DECLARED], ["edge_type"]), _edges(spark, d))


# Claims (P)

_N = "tall_n AS (SELECT *, n_orders AS n FROM tall)"
_CLAIMS = f"""claims AS (SELECT substr(sha256(CAST(id AS VARCHAR) || ':' || 'capability:' || capability || ':' || 'v1'), 1, 16) AS claim_id, id, 'capability' AS claim_type, capability, score,
  {sql_bands('score', C.LEVELS, 'Below Average')} AS level, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence, 'scores|v1|weighted_score,levels' AS provenance FROM tall_n)"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    c = C.capability_claims(_tall(spark, d).withColumn("n", F.col("n_orders")), "id", "v1")
    p = C.provenance("scores", "v1", ["weighted_score", "levels"])
    return c.withColumn("provenance", F.concat_ws("|", p["engine"], p["fingerprint"], F.array_join(p["rules"], ",")))


@register(f"WITH {SCORES}, {_TALL}, {_N}, {_CLAIMS} SELECT * FROM claims")
def claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each score with an id, level and confidence."""
    return _claims(spark, d)


@register(f"""WITH {SCORES} SELECT id, array_to_string(list_filter([CASE WHEN n_orders < 3 THEN 'sample_size:material' WHEN n_orders < 5 THEN 'sample_size:cautionary' WHEN n_orders < 10 THEN 'sample_size:informational' END,
  CASE WHEN exposure < 450 THEN 'minutes:cautionary' END, CASE WHEN cohort NOT IN ('Multiple', 'All Competitions Career') THEN 'league_context:informational' END,
  CASE WHEN threat > creation AND n_orders < 5 THEN 'regression_risk:cautionary' END, CASE WHEN progression >= 75 AND team NOT IN ('NATION_1', 'NATION_2') THEN 'role_dependence:informational' END,
  CASE WHEN threat - creation > 40 THEN 'overperformance:informational' END], lambda x: x IS NOT NULL), ',') AS qualifiers FROM scores""")
def qualifiers(spark: SparkSession, d: str) -> DataFrame:
    """Caveats of an entity's claims, all six kinds."""
    over = (F.col("threat") - F.col("creation")).cast("double")
    rules = [*C.sample_rules("n_orders", "exposure"), *C.context_rules(F.col("cohort"), over, F.col("n_orders"), F.col("progression") >= 75, F.col("team"), ["NATION_1", "NATION_2"], 40.0)]
    return entity_scores(spark, d).select("id", F.array_join(C.qualifiers(rules), ",").alias("qualifiers"))


@register(f"""WITH {SCORES}, {_MEANS}, t AS (SELECT team, capability, score FROM means UNPIVOT (score FOR capability IN ({', '.join(CAPABILITIES)}))),
m AS (SELECT *, avg(score) OVER (PARTITION BY team) AS mean FROM t)
SELECT team, array_to_string(list_transform(string_split(capability, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS label, {rnd('score - mean', 4)} AS gap, score < 40 AS weak FROM m WHERE abs(score - mean) > 3""")
def team_claims(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities of a team far from its own mean."""
    t = T.long_scores(_means(spark, d), ["team"], CAPABILITIES).withColumn("mean", F.avg("score").over(Window.partitionBy("team")))
    return t.where(F.abs(F.col("score") - F.col("mean")) > 3).select("team", title(F.col("capability")).alias("label"), rounded(F.col("score") - F.col("mean"), 4).alias("gap"), (F.col("score") < 40).alias("weak"))


_FOUND = "found AS (SELECT conv_id, CASE role WHEN 'user' THEN 'capability' WHEN 'assistant' THEN 'archetype' ELSE 'role_fit' END AS claim_type FROM conversations)"


@register(f"""WITH {_FOUND}, sought AS (SELECT conv_id, unnest(['archetype', 'capability', 'fragility', 'role_fit']) AS claim_type FROM (SELECT DISTINCT conv_id FROM conversations)),
f AS (SELECT DISTINCT conv_id, claim_type FROM found), j AS (SELECT s.conv_id, s.claim_type, f.claim_type IS NOT NULL AS ok FROM sought s LEFT JOIN f USING (conv_id, claim_type))
SELECT conv_id, count(*) FILTER (WHERE ok) AS n_satisfied, coalesce(string_agg(claim_type, ',' ORDER BY claim_type) FILTER (WHERE NOT ok), '') AS missing, bool_and(ok) AS complete, bool_and(ok OR claim_type IN ('fragility', 'role_fit')) AS valid FROM j GROUP BY 1""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Claim types sought, found and missing by conversation."""
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "capability").when(F.col("role") == "assistant", "archetype").otherwise("role_fit")
    types = F.array(*[F.lit(x) for x in ("archetype", "capability", "fragility", "role_fit")])
    return C.coverage(c.select("conv_id").distinct().select("conv_id", F.explode(types).alias("claim_type")), c.select("conv_id", kind.alias("claim_type")), "conv_id", ["fragility", "role_fit"])


@register(f"""WITH {SCORES}, {_TALL}, {_N}, {_CLAIMS}, i AS (SELECT c_custkey AS id, 'q' || CAST(c_custkey AS VARCHAR) AS intent_id, unnest(['creation', 'threat']) AS capability FROM customer)
SELECT intent_id, count(*) AS n_claims, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids FROM i JOIN claims USING (id, capability) GROUP BY 1""")
def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The claims that each question asks for."""
    asked = F.explode(F.array(F.lit("creation"), F.lit("threat")))
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("intent_id"), asked.alias("capability"))
    return C.bundles(i, _claims(spark, d), ["id", "capability"], "intent_id")


_STYLE_SQL = ", ".join(f"{{'style': '{n}', 'fit': {rnd(' + '.join(f'{k} * {v}e0' for k, v in w.items()), 4)}}}" for n, w in D.STYLE_WEIGHTS.items() if n != "Balanced")


@register(f"""WITH {SCORES}, f AS (SELECT id, unnest([{_STYLE_SQL}]) AS s FROM scores)
SELECT id, s.style AS style, s.fit AS fit, {sql_bands('s.fit', D.FIT_LABELS, 'Poor')} AS label, substr(sha256(CAST(id AS VARCHAR) || ':role_fit:' || s.style), 1, 12) AS claim_id FROM f""")
def role_fit_claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each entity and style of play."""
    fits = F.array(*[F.struct(F.lit(n).alias("style"), rounded(D.alignment(n), 4).alias("fit")) for n in D.STYLE_WEIGHTS if n != "Balanced"])
    f = entity_scores(spark, d).select("id", F.explode(fits).alias("s")).select("id", "s.style", "s.fit")
    return f.withColumn("label", D.fit_label(F.col("fit"))).withColumn("claim_id", short_id(F.col("id").cast("string"), F.lit("role_fit"), F.col("style"), length=12))


@register(f"""WITH {SCORES}, {_TALL}, m AS (SELECT id, string_agg(capability, ',' ORDER BY score DESC, capability) AS metrics, bool_or(capability = 'threat') AS has_threat, min(n_orders) AS n FROM tall GROUP BY id)
SELECT c_custkey AS id, metrics, array_to_string(list_filter([CASE WHEN trim(c_name) = '' THEN 'title' END, CASE WHEN NOT coalesce(has_threat, false) THEN 'metric:threat' END, CASE WHEN n < 5 THEN 'members' END], lambda x: x IS NOT NULL), ',') AS faults
FROM m JOIN customer ON id = c_custkey""")
def evidence_packets(spark: SparkSession, d: str) -> DataFrame:
    """Nested packets of the scores, and what they lack."""
    t = _tall(spark, d).withColumn("confidence", F.lit(1.0))
    names = entity_scores(spark, d).select("id", "name", "n_orders")
    p = E.packets(t, "id", names, "name").join(names.select("id", "n_orders"), "id")
    return p.select("id", F.array_join(F.col("metrics.metric_name"), ",").alias("metrics"), F.array_join(E.packet_faults(["threat"], F.col("n_orders") >= 5), ",").alias("faults"))


_PLAN_SQL = lambda i: "CASE strategy " + " ".join(f"WHEN '{n}' THEN '{','.join(p[i])}'" for n, p in E.PLANS.items()) + " END"


@register(f"""WITH i AS (SELECT conv_id, turn, text, {{intent}} AS intent FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'team_intelligence' END AS ws FROM conversations)),
s AS (SELECT *, CASE WHEN intent = 'COMPARE_PLAYERS' THEN 1e0 ELSE 0e0 END AS comparison, CASE WHEN intent = 'PLAYER_ANALYSIS' THEN 1e0 WHEN contains(lower(text), 'player') THEN 0.6e0 ELSE 0e0 END AS player,
  CASE WHEN intent = 'TEAM_ANALYSIS' THEN 1e0 WHEN contains(lower(text), 'team') THEN 0.4e0 ELSE 0e0 END AS team, CASE WHEN intent = 'RECRUITMENT' THEN 0.8e0 WHEN contains(lower(text), 'replace') THEN 0.9e0 ELSE 0e0 END AS replacement, 0.5e0 AS general FROM i),
c AS (SELECT conv_id, turn, CASE {" ".join(f"WHEN {n} = greatest(comparison, player, team, replacement, general) THEN '{n}'" for n in ("comparison", "player", "team", "replacement", "general"))} END AS strategy FROM s)
SELECT *, {_PLAN_SQL(0)} AS steps, {_PLAN_SQL(1)} AS expected FROM c""".replace("{intent}", "@INTENT@"))
def strategy_choice(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval strategy with the largest score, and its plan."""
    c = table(spark, d, "conversations")
    kind = X.intent(F.col("text"), F.when(F.col("conv_id") % 3 == 0, "team_intelligence"))
    scores = E.strategy_scores(F.col("intent"), F.col("text"))
    chosen = c.withColumn("intent", kind).withColumns(scores).select("conv_id", "turn", E.prefer(list(scores)).alias("strategy"))
    plan = E.plans(F.col("strategy"))
    return chosen.select("conv_id", "turn", "strategy", F.array_join(plan["steps"], ",").alias("steps"), F.array_join(plan["expected"], ",").alias("expected"))


# Text (Q)

def _marked(x: str) -> str:
    """SQL of x with \\x01 and \\x02 around each word: DuckDB's \\b knows only ASCII words."""
    return f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_]+)', '\x01\\1\x02', 'g')"


def _sql_rewrites(x: str) -> str:
    x = _marked(x)
    for p, by in X.REWRITES:
        core, flags = p.removeprefix("(?i)"), "'gi'" if p.startswith("(?i)") else "'g'"
        new = re.sub(r"\w+", "\x01\\g<0>\x02", by)
        if core.startswith("'s"):
            core = "''\x01s\x02"
        elif core.startswith("s'"):
            core, new = "s\x02''\x01", "s"
        elif core.startswith(r"\b"):
            core = "\x01" + core[2:-2].replace(r"\.?\s*", "\x02?\\.?\\s*\x01?") + "\x02"
        x = f"regexp_replace({x}, '{core}', '{new}', {flags})"
    return f"translate({x}, '\x01\x02', '')"


@register("SELECT conv_id, turn, " + _sql_rewrites("text") + " AS normalized FROM conversations")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rewrites of whole questions (Q1)."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalized_query(F.col("text")).alias("normalized"))


_PLAIN = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_FOLD = "trim(regexp_replace(regexp_replace(" + _PLAIN + ", '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@register(f"SELECT conv_id, turn, {_FOLD.format('text')} AS folded FROM conversations")
def folded_text(spark: SparkSession, d: str) -> DataFrame:
    """Name normal form."""
    return table(spark, d, "conversations").select("conv_id", "turn", folded_name(F.col("text")).alias("folded"))


_NAMES = f"ent AS (SELECT DISTINCT n_nationkey AS key, {_FOLD.format('n_name')} AS n FROM nation UNION SELECT DISTINCT 1000 + p_partkey, {_FOLD.format('p_name')} FROM part)"
_WORDS = f"""wd AS (SELECT page_id AS query, list_filter(string_split({_FOLD.format('html')}, ' '), lambda x: x <> '') AS w FROM pages),
gr AS (SELECT query, p, n, array_to_string(w[p:p + n - 1], ' ') AS token FROM wd, (VALUES (2), (3), (4)) k(n), unnest(range(1, len(w) - n + 2)) AS t(p)),
fa AS (SELECT DISTINCT query, p, gr.n, token, key FROM gr JOIN ent ON gr.token = ent.n),
fo AS (SELECT * FROM fa a WHERE NOT EXISTS (SELECT 1 FROM fa o WHERE o.query = a.query AND o.n > a.n AND o.p <= a.p AND o.p + o.n >= a.p + a.n)),
cv AS (SELECT DISTINCT query, unnest(range(p, p + n)) AS p FROM fo),
sg AS (SELECT query, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM wd),
tok AS (SELECT DISTINCT query, token FROM sg ANTI JOIN cv USING (query, p) WHERE length(token) > 1 AND token NOT IN ({', '.join(f"'{w}'" for w in X.STOP_WORDS)}))"""
_INDEX = """w AS (SELECT key, unnest(string_split(n, ' ')) AS w FROM ent),
idx AS (SELECT DISTINCT * FROM (SELECT n AS token, key, 1 AS kind FROM ent UNION ALL SELECT w, key, 2 FROM w UNION ALL SELECT w[1:i], key, 2 FROM w, unnest(range(4, length(w) + 1)) AS t(i) WHERE length(w) > 4)),
j AS (SELECT query, tok.token, key, kind, min(kind) OVER (PARTITION BY query, tok.token) AS first FROM tok JOIN idx ON tok.token = idx.token),
one AS (SELECT query, token, count(DISTINCT key) AS n_candidates, min(key) AS k FROM j WHERE kind = first GROUP BY 1, 2),
res AS (SELECT * FROM one UNION ALL SELECT query, token, count(DISTINCT key), min(key) FROM fo GROUP BY 1, 2),
nm AS (SELECT DISTINCT query, key FROM fo)"""


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entities of the pages' names and tokens, the names found whole, and the candidates' index. Parts of the same
    name are one entity with a size."""
    n, p = table(spark, d, "nation"), table(spark, d, "part")
    e = n.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")).unionByName(p.select((F.col("p_partkey") + 1000).alias("key"), F.col("p_name").alias("name")))
    index, pages = written(X.name_index(X.name_classes(e, "key", "name"), "key", "name", size="size")), table(spark, d, "pages")
    names = index.where("kind = 1")
    whole = written(L.found_names(pages, "page_id", "html", names.select("token")))
    single = X.resolved(X.single_tokens(pages, "page_id", "html", whole), index)
    several = X.resolved(whole, names)
    return single.unionByName(several), whole, index


@register(f"WITH {_NAMES}, {_WORDS}, {_INDEX} SELECT query, token, CAST(CASE WHEN n_candidates = 1 THEN k END AS BIGINT) AS key, n_candidates FROM res")
def resolve_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Entities of every page: names of several words first, the longest before those in it, then words by whole
    name, word or prefix, without stop words (Q3, Q5-Q7)."""
    return _resolved(spark, d)[0]


@register(f"""WITH {_NAMES}, {_WORDS}, {_INDEX}, amb AS (SELECT query, token FROM res WHERE n_candidates > 1),
left_ AS (SELECT a.query, a.token FROM amb a JOIN (SELECT token, key FROM idx) i ON a.token = i.token ANTI JOIN nm ON a.query = nm.query AND i.key = nm.key GROUP BY 1, 2 HAVING count(DISTINCT i.key) > 1)
SELECT query, count(*) AS n_ambiguous FROM left_ GROUP BY query""")
def ambiguous_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with several candidates that no full name in the text covers (Q8)."""
    found, whole, index = _resolved(spark, d)
    open_ = found.where("n_candidates > 1").select("query", "token").distinct().join(X.token_sizes(index).hint("merge"), "token")
    # Of a token's entities, those of the names found whole in the text are covered: few names, each of few tokens.
    named = whole.select("query", F.col("token").alias("name")).distinct().join(index.where("kind = 1").select(F.col("token").alias("name"), "key").hint("merge"), "name").select("query", "key").distinct()
    covered = named.join(index.select("token", "key", "size").distinct().hint("merge"), "key").groupBy("query", "token").agg(F.sum("size").alias("covered"))
    left = open_.join(covered, ["query", "token"], "left").where(F.col("size") - F.coalesce("covered", F.lit(0)) > 1)
    return left.groupBy("query").agg(F.count("*").alias("n_ambiguous"))


def _sql_any(words: tuple) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_INTENT = "CASE " + " ".join(f"WHEN {_sql_any(w)} THEN '{i}'" for w, i in [*X.INTENTS_FIRST]) + " " + " ".join(f"WHEN ws = '{k}' THEN '{i}'" for k, i in X.WORKSPACES.items()) + " " + " ".join(f"WHEN {_sql_any(w)} THEN '{i}'" for w, i in X.INTENTS_LAST) + " ELSE 'GENERAL' END"


ORACLES["strategy_choice"] = ORACLES["strategy_choice"].replace("@INTENT@", _INTENT)


@register(f"SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'team_intelligence' END AS ws FROM conversations)")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    """Ordered keyword rules and the workspace (Q9)."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.intent(F.col("text"), F.when(F.col("conv_id") % 3 == 0, "team_intelligence")).alias("intent"))


def _sql_subjective() -> str:
    """The patterns over text with marked words."""
    alternatives = lambda p: re.sub(r"\(\?:(.*)\)", lambda m: "(" + "|".join("\x01" + a.replace(" ", "\x02 \x01") + "\x02" for a in m[1].split("|")) + ")", p)
    plain = [re.sub(r"\\b(\w+)\\b", "\x01\\g<1>\x02", alternatives(p).replace(r"\b(", "(").replace(r")\b", ")")) for p in X.SUBJECTIVE]
    return "(" + " OR ".join(f"regexp_matches({_marked('text')}, '(?i){p}')" for p in plain) + ")"


@register(f"SELECT conv_id, turn, coalesce({_sql_subjective()}, false) AS subjective, strlen(text) AS n_bytes FROM conversations")
def subjective_questions(spark: SparkSession, d: str) -> DataFrame:
    """Pattern filter and sizes in bytes."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.is_subjective(F.col("text")).alias("subjective"), F.octet_length("text").cast("long").alias("n_bytes"))


#: Questions derived from orders: a customer's are a conversation, about parts (players) and nations (teams). Lots have
#: names of seven words; the short names of parts are aliases of players, those of red ones of teams, too.
_LOT = "({0}.p_name || ' of lot ' || {0}.p_partkey || ' grade ' || {0}.p_partkey % 7)"
_QUESTION_SQL = f"""q AS (SELECT o_orderkey AS query, o_custkey AS conv, CASE o_orderkey % 7 WHEN 0 THEN 'Compare ' || {_LOT.format('a')} || ' and ' || {_LOT.format('b')} WHEN 1 THEN 'Who is better under pressure?'
  WHEN 2 THEN 'Analyze the squad of ' || replace(n_name, '_', ' ') WHEN 3 THEN 'What are his strengths?' WHEN 4 THEN 'compare him with ' || {_LOT.format('b')}
  WHEN 5 THEN 'Sign ' || a.p_name || ' for ' || replace(n_name, '_', ' ') ELSE 'What if ' || replace(n_name, '_', ' ') || ' plays without ' || {_LOT.format('a')} || '?' END AS text
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p1, max(l_partkey) AS p2 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  JOIN part a ON a.p_partkey = p1 JOIN part b ON b.p_partkey = p2 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""
_MENTION_SQL = f"""{_QUESTION_SQL},
pn AS (SELECT CAST(p_partkey AS BIGINT) AS key, {_FOLD.format(_LOT.format('part'))} AS n FROM part), tn AS (SELECT CAST(n_nationkey AS BIGINT) AS key, {_FOLD.format("replace(n_name, '_', ' ')")} AS n FROM nation),
pa AS (SELECT {_FOLD.format('p_name')} AS token, min(p_partkey) AS key FROM part GROUP BY 1), ta AS (SELECT token, key % 25 AS key FROM pa WHERE token LIKE 'red %'),
nms AS (SELECT n AS token FROM pn UNION SELECT n FROM tn UNION SELECT token FROM pa),
wd AS (SELECT query, list_filter(string_split({_FOLD.format('text')}, ' '), lambda x: x <> '') AS w FROM q),
gr AS (SELECT query, p, n, array_to_string(w[p:p + n - 1], ' ') AS token FROM wd, unnest(range(2, 8)) AS k(n), unnest(range(1, len(w) - n + 2)) AS t(p)),
fa AS (SELECT gr.* FROM gr JOIN nms USING (token)),
fo AS (SELECT * FROM fa a WHERE NOT EXISTS (SELECT 1 FROM fa o WHERE o.query = a.query AND o.n > a.n AND o.p <= a.p AND o.p + o.n >= a.p + a.n)),
cv AS (SELECT DISTINCT query, unnest(range(p, p + n)) AS p FROM fo),
sg AS (SELECT query, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM wd),
tok AS (SELECT query, token, min(place) AS place FROM (SELECT query, token, [0, -length(token), p] AS place FROM fo
  UNION ALL SELECT query, token, [1, 0, p] FROM sg ANTI JOIN cv USING (query, p) WHERE length(token) > 1 AND token NOT IN ({', '.join(f"'{w}'" for w in X.STOP_WORDS)})) GROUP BY 1, 2),
ents AS (SELECT 't' AS kind, key, n FROM tn UNION ALL SELECT 'p', key, n FROM pn), ws AS (SELECT kind, key, unnest(string_split(n, ' ')) AS w FROM ents),
idx AS (SELECT DISTINCT * FROM (SELECT kind, n AS token, key, 1 AS level FROM ents UNION ALL SELECT kind, w, key, 2 FROM ws UNION ALL SELECT kind, w[1:i], key, 2 FROM ws, unnest(range(4, length(w) + 1)) AS t(i) WHERE length(w) > 4
  UNION ALL SELECT 'p', token, key, 0 FROM pa UNION ALL SELECT 't', token, key, 0 FROM ta)),
hit AS (SELECT query, token, kind, count(DISTINCT key) AS c, min(key) AS key FROM (SELECT query, token, kind, key, level, min(level) OVER (PARTITION BY query, token, kind) AS first FROM tok JOIN idx USING (token)) WHERE level = first GROUP BY 1, 2, 3),
one AS (SELECT tok.*, t.key AS team, p.key AS player FROM tok LEFT JOIN hit t ON t.query = tok.query AND t.token = tok.token AND t.kind = 't' AND t.c = 1 LEFT JOIN hit p ON p.query = tok.query AND p.token = tok.token AND p.kind = 'p' AND p.c = 1),
seen AS (SELECT *, row_number() OVER (PARTITION BY query, team ORDER BY place) > 1 AS again FROM one),
ps AS (SELECT query, list(player ORDER BY place) AS p FROM (SELECT query, player, min(place) AS place FROM seen WHERE player IS NOT NULL AND (team IS NULL OR again) GROUP BY 1, 2) GROUP BY 1),
ts AS (SELECT query, list(team ORDER BY place) AS t FROM (SELECT query, team, min(place) AS place FROM seen WHERE team IS NOT NULL AND NOT again GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT conv, query, text, {_INTENT} AS kind, coalesce(p, []) AS p, coalesce(t, []) AS t FROM (SELECT *, NULL AS ws FROM q) LEFT JOIN ps USING (query) LEFT JOIN ts USING (query))"""
_ROLE_SQL = f"""{_MENTION_SQL},
r AS (SELECT *, kind = 'COMPARE_PLAYERS' AND len(p) >= 2 AS pair, kind = 'COMPARE_PLAYERS' AND len(p) < 2 AND len(t) >= 2 AS clubs, kind IN ('PLAYER_ANALYSIS', 'COUNTERFACTUAL') AND len(p) >= 1 AS single,
  kind = 'COUNTERFACTUAL' AND len(p) >= 1 AND len(t) >= 1 AS scenario, kind = 'RECRUITMENT' AND len(p) >= 1 AS hire, kind = 'RECRUITMENT' AND len(p) = 0 AND len(t) >= 1 AS squad, kind = 'TEAM_ANALYSIS' AND len(t) >= 1 AS club FROM f),
e AS (SELECT *, NOT (pair OR clubs OR single OR hire OR squad OR club) AS rest FROM r),
o AS (SELECT *, CASE WHEN pair OR single OR hire OR (rest AND len(p) >= 1) THEN p[1] END AS focus_player, CASE WHEN pair THEN p[2] END AS compare_player,
  CASE WHEN clubs OR scenario OR squad OR club OR (rest AND len(p) = 0 AND len(t) >= 1) THEN t[1] END AS team, CASE WHEN clubs THEN t[2] END AS team_compare FROM e),
i AS (SELECT *, CASE WHEN clubs OR scenario OR squad THEN 'TEAM_ANALYSIS' WHEN kind = 'GENERAL' AND team IS NOT NULL THEN 'TEAM_ANALYSIS' WHEN kind = 'GENERAL' AND focus_player IS NOT NULL THEN 'PLAYER_ANALYSIS' ELSE kind END AS intent FROM o)"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    lot = lambda p: F.concat(F.col(f"{p}.p_name"), F.lit(" of lot "), F.col(f"{p}.p_partkey"), F.lit(" grade "), F.col(f"{p}.p_partkey") % 7)
    part, nation, number = table(spark, d, "part"), table(spark, d, "nation"), F.col("o_orderkey") % 7
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p1"), F.max("l_partkey").alias("p2"))
    j = table(spark, d, "orders").join(ends, F.col("l_orderkey") == F.col("o_orderkey")).join(part.alias("a"), F.col("a.p_partkey") == F.col("p1")).join(part.alias("b"), F.col("b.p_partkey") == F.col("p2"))
    j = j.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    team = F.translate("n_name", "_", " ")
    texts = [
        F.concat(F.lit("Compare "), lot("a"), F.lit(" and "), lot("b")), F.lit("Who is better under pressure?"), F.concat(F.lit("Analyze the squad of "), team), F.lit("What are his strengths?"),
        F.concat(F.lit("compare him with "), lot("b")), F.concat(F.lit("Sign "), F.col("a.p_name"), F.lit(" for "), team), F.concat(F.lit("What if "), team, F.lit(" plays without "), lot("a"), F.lit("?")),
    ]
    said = F.when(number == 0, texts[0])
    for i in range(1, 7):
        said = said.when(number == i, texts[i])
    questions = written(j.select(F.col("o_orderkey").alias("query"), F.col("o_custkey").alias("conv"), said.alias("text")))

    lots = part.alias("part").select(F.col("p_partkey").cast("long").alias("key"), lot("part").alias("name"))
    nations = nation.select(F.col("n_nationkey").cast("long").alias("key"), team.alias("name"))
    short = part.groupBy(folded_name(F.col("p_name")).alias("token")).agg(F.min("p_partkey").cast("long").alias("key"))
    red = short.where("token LIKE 'red %'").select("token", (F.col("key") % 25).alias("key"))
    players, teams = X.name_index(lots, "key", "name"), X.name_index(nations, "key", "name")
    names = players.where("kind = 1").select("token", "key").unionByName(teams.where("kind = 1").select("token", "key")).unionByName(short)
    found = L.resolve_both(L.question_tokens(questions, "query", "text", names), players, teams, short, red)
    both = questions.join(found, "query", "left").withColumns({c: F.coalesce(c, F.array().cast("array<long>")) for c in ("players", "teams")})
    return both.withColumn("r", X.routed(X.intent(F.col("text")), F.col("players"), F.col("teams"))).select("conv", "query", "text", "players", "teams", "r.*")


@register(f"WITH {_ROLE_SQL} SELECT conv, query, array_to_string(p, ',') AS players, array_to_string(t, ',') AS teams, intent, focus_player, compare_player, team, team_compare FROM i")
def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Players and teams of questions, teams first and with aliases, their roles, and rerouting (Q4-Q7, Q11)."""
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _routed(spark, d).select("conv", "query", listed("players"), listed("teams"), "intent", "focus_player", "compare_player", "team", "team_compare")


def _sql_said(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@register(f"""WITH {_ROLE_SQL},
a AS (SELECT *, len(p) + len(t) = 0 AND {_sql_said(L.PAIR_WORDS)} AS asks, intent = 'COMPARE_PLAYERS' AS cmp FROM i),
b AS (SELECT *, last_value(CASE WHEN NOT asks OR cmp THEN cmp END IGNORE NULLS) OVER w AS compared, last_value(CASE WHEN compare_player IS NOT NULL THEN focus_player END IGNORE NULLS) OVER w AS first FROM a WINDOW w AS (PARTITION BY conv ORDER BY query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN coalesce(compared, false) AND first IS NOT NULL THEN CASE WHEN asks THEN 'pair' WHEN {_sql_said(L.SWAPS)} AND len(p) = 1 AND compare_player IS NULL THEN 'swap' END END AS k FROM b),
g AS (SELECT *, last_value(CASE WHEN compare_player IS NOT NULL THEN compare_player WHEN k = 'swap' THEN p[1] END IGNORE NULLS) OVER w AS second, last_value(CASE WHEN k IS NOT NULL THEN first ELSE focus_player END IGNORE NULLS) OVER w AS was, last_value(team IGNORE NULLS) OVER w AS team_was
  FROM c WINDOW w AS (PARTITION BY conv ORDER BY query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, k IS NULL AND len(p) + len(t) = 0 AND {_sql_said(L.FOCUS_WORDS)} AND was IS NOT NULL AS same FROM g),
z AS (SELECT *, CASE WHEN k IS NOT NULL THEN first WHEN same THEN was ELSE focus_player END AS focus FROM h)
SELECT conv, query, CASE WHEN k IS NOT NULL THEN 'COMPARE_PLAYERS' WHEN same AND intent = 'GENERAL' THEN 'PLAYER_ANALYSIS' ELSE intent END AS intent, focus AS focus_player, CASE k WHEN 'pair' THEN second WHEN 'swap' THEN p[1] ELSE compare_player END AS compare_player, team,
  coalesce(k, CASE WHEN same THEN 'focus' END) AS reused, coalesce(focus <> was, focus IS NOT NULL) AS player_changed, coalesce(team <> team_was, team IS NOT NULL) AS team_changed FROM z""")
def dialogue_state(spark: SparkSession, d: str) -> DataFrame:
    """What follow-up questions refer to, and turns where the player or team in focus changes (Q12, Q14)."""
    out = L.followed_up(_routed(spark, d), "conv", "query")
    return out.select("conv", "query", "intent", "focus_player", "compare_player", "team", "reused", "player_changed", "team_changed")


@register("""WITH v AS (SELECT *, CASE WHEN length(text) % 3 = 0 THEN substr(text, 1, 8) END AS focus FROM conversations)
SELECT conv_id, turn, last_value(focus IGNORE NULLS) OVER w AS focus, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, false) AS changed FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)""")
def follow_up_context(spark: SparkSession, d: str) -> DataFrame:
    """The last focus of a conversation, and turns where the context changes (Q12, Q14)."""
    t = table(spark, d, "conversations").withColumn("focus0", F.when(F.char_length("text") % 3 == 0, F.substring("text", 1, 8))).withColumn("at", F.struct("turn", "role", "text"))
    return X.carried_context(t, "conv_id", "at", "focus0", "focus").withColumn("changed", X.changed("role", "conv_id", "at")).select("conv_id", "turn", "focus", "changed")


_HITS = "(CASE WHEN contains(lower(p_name), 'part') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), '1') THEN 1 ELSE 0 END)"


@register(f"""WITH s AS (SELECT p_partkey, CASE WHEN lower(p_name) = 'part 1' THEN 1000 WHEN starts_with(lower(p_name), 'part 1') THEN 500 WHEN {_HITS} = 2 THEN 220 WHEN contains(lower(p_name), 'part 1') THEN 100 ELSE 10 * {_HITS} END AS s, p_retailprice FROM part)
SELECT p_partkey, {rnd('CASE WHEN s > 0 THEN s + least(p_retailprice / 10000e0, 50e0) ELSE 0e0 END', 4)} AS score FROM s ORDER BY score DESC, p_partkey LIMIT 5""")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """The five best hits of a name search (Q13): a top-k report."""
    s = rounded(X.search_score(F.col("p_name"), "part 1", F.col("p_retailprice")), 4)
    return table(spark, d, "part").select("p_partkey", s.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(5)


@register(f"""WITH a AS (SELECT year(o_orderdate) AS run, o_orderpriority AS category, avg(o_totalprice) AS latency, max(length(o_orderpriority)) AS size FROM orders GROUP BY 1, 2)
SELECT x.run, x.category, {rnd('y.latency - x.latency', 4)} AS latency_delta, {rnd('(y.latency / x.latency - 1e0) * 100e0', 4)} AS latency_pct, y.size - x.size AS size_delta FROM a x JOIN a y ON x.category = y.category AND y.run = x.run + 1""")
def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Each run's results against the next run's, paired by category."""
    a = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("run"), F.col("o_orderpriority").alias("category")).agg(F.avg("o_totalprice").alias("latency"), F.max(F.length("o_orderpriority")).alias("size"))
    x, y = a.alias("x"), a.select((F.col("run") - 1).alias("run"), "category", F.col("latency").alias("later"), F.col("size").alias("size2"))
    return x.join(y, ["run", "category"]).select(
        F.col("run").cast("long").alias("run"), "category", rounded(F.col("later") - F.col("latency"), 4).alias("latency_delta"), rounded((F.col("later") / F.col("latency") - 1.0) * 100.0, 4).alias("latency_pct"), (F.col("size2") - F.col("size")).cast("long").alias("size_delta"),
    )


# Data quality, logs and evaluation (C, F24, F27, F30, R3)

@register("""WITH e AS (SELECT event_id, user_id, value, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) > 1 AS rep FROM events),
r AS (SELECT user_id IS NULL AS a, rep AS b, value < 1 AS c, value > 90 AS w FROM e)
SELECT 'events' AS dataset, count(*) AS total, count(*) FILTER (WHERE NOT (a OR b OR c)) AS clean, count(*) FILTER (WHERE a OR b OR c) AS errors, count(*) FILTER (WHERE w) AS warnings,
  count(*) FILTER (WHERE a) AS null_user_id, count(*) FILTER (WHERE b) AS repeated_user_id_event_type_ts, count(*) FILTER (WHERE c) AS small_value, count(*) FILTER (WHERE w) AS large_value,
  count(*) FILTER (WHERE a OR b OR c) = 0 AS is_valid, floor(count(*) FILTER (WHERE NOT (a OR b OR c)) * 1000e0 / count(*) + 0.5e0) / 10e0 AS validity_pct FROM r""")
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    """Null, repeat and range rules in one report."""
    rules = [Q.null_rule("user_id"), Q.repeat_rule(["user_id", "event_type", "ts"], ["event_id"]), Q.range_rule("small_value", F.col("value") < 1), Q.range_rule("large_value", F.col("value") > 90, "warning")]
    return Q.report(table(spark, d, "events"), rules, "events")


@register("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS n_high, floor(count(*) FILTER (WHERE value >= 50) * 1000e0 / count(*) + 0.5e0) / 10e0 AS used_pct, round(avg(value), 6) AS avg_value,
  round(max(value), 6) AS max_value, round(max(CASE WHEN k = n // 2 + 1 THEN value END), 6) AS p50, array_to_string(list_sort(list(DISTINCT user_id % 5)), ',') AS kinds FROM v GROUP BY 1""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, shares, means, maxima, the upper median and distinct sets by type (F24). Values are ranked by bucketed counts."""
    from cohortry.operators.cohort import group_ranks

    e = group_ranks(table(spark, d, "events").select("event_type", "user_id", "value"), ["event_type"], "value")
    middle = F.floor(F.col("__n") / 2) + 1  # the value whose ties hold this place
    at = (F.col("__rank") <= middle) & (middle < F.col("__rank") + F.col("__ties"))
    high = F.count_if(F.col("value") >= 50)
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), high.alias("n_high"), rounded(high * 100.0 / F.count("*"), 1).alias("used_pct"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.max("value"), 6).alias("max_value"),
        F.round(F.max(F.when(at, F.col("value"))), 6).alias("p50"), F.array_join(F.array_sort(F.collect_set(F.col("user_id") % 5)), ",").alias("kinds"),
    )


@register(f"""SELECT o_custkey AS id, arg_min(o_orderstatus, o_orderkey) AS first_status, {rnd('sum(o_totalprice)', 2)} AS total, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses, count(*) AS n FROM orders GROUP BY 1""")
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    """One row an entity with its first label, its sum, and its distinct labels joined."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), rounded(F.sum("o_totalprice"), 2).alias("total"), joined("o_orderpriority").alias("priorities"), joined("o_orderstatus").alias("statuses"), F.count("*").alias("n"))


@register(f"""SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failures, round(max(o_totalprice), 2) AS max_latency,
  count(*) FILTER (WHERE o_orderstatus <> 'F') * 2 <= count(*) AND max(o_totalprice) < 3000000 AS ok, {rnd('avg(CASE WHEN o_orderstatus = $$F$$ THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN o_orderstatus = $$O$$ THEN 1e0 ELSE 0e0 END)', 6)} AS paired_delta FROM orders GROUP BY 1""")
def benchmark_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Results by category with thresholds."""
    good, bad = F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F"
    share = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, 1.0).otherwise(0.0))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(
        F.count("*").alias("n"), F.count_if(good).alias("passed"), F.count_if(bad).alias("failures"), F.round(F.max("o_totalprice"), 2).alias("max_latency"),
        ((F.count_if(bad) * 2 <= F.count("*")) & (F.max("o_totalprice") < 3000000)).alias("ok"), rounded(share("F") - share("O"), 6).alias("paired_delta"),
    )


@register("""SELECT 'orders' AS dataset, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the inputs."""
    from cohortry.sources.tables import row_counts

    return row_counts({t: table(spark, d, t) for t in ("orders", "lineitem", "events")})


_EDITED = "SELECT * REPLACE (CASE WHEN l_orderkey % 1000 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem WHERE l_orderkey % 1000 <> 1 AND l_partkey % 100 <> 7"


@register(f"""WITH b AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_partkey % 100 <> 8 GROUP BY 1), e AS ({_EDITED}), a AS (SELECT l_partkey AS part, count(*) AS n FROM e GROUP BY 1),
c AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_orderkey % 1000 <= 1)
SELECT part, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_now, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a USING (part) WHERE b.n IS NULL OR a.n IS NULL OR part IN (SELECT part FROM c)""")
def content_changes(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose order lines changed between two versions of the table, by order-free sums of row hashes."""
    lines = table(spark, d, "lineitem")
    edited = lines.where("l_orderkey % 1000 <> 1 AND l_partkey % 100 <> 7").withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_orderkey") % 1000 == 0, 1).otherwise(0))
    by = {"part": F.col("l_partkey")}
    return changed_partitions(content_fingerprint(lines.where("l_partkey % 100 <> 8"), by), content_fingerprint(edited, by), ["part"])


@register(f"""WITH {SCORES}, s AS (SELECT * FROM scores WHERE id % 50 <> 3), l AS (SELECT c_custkey AS id, e.id AS e, s.id AS s, CASE WHEN s.id % 70 = 5 AND e.team <> 'moved' THEN 1 ELSE 0 END AS n FROM customer LEFT JOIN entity e ON e.id = c_custkey LEFT JOIN s ON s.id = c_custkey)
SELECT id, 'source' || CASE WHEN e IS NOT NULL THEN ',facts' ELSE '' END || CASE WHEN s IS NOT NULL THEN ',scores' ELSE '' END AS stages, CASE WHEN e IS NULL THEN 'facts' WHEN s IS NULL THEN 'scores' END AS lost, CAST(1 AS BIGINT) AS rows,
  CASE WHEN n = 1 THEN 'team@scores' ELSE '' END AS differences FROM l""")
def lineage_trace(spark: SparkSession, d: str) -> DataFrame:
    """All customers from the source through facts to scores: where one is lost, and which values differ (R2). The
    scores' stage lacks some, and has others in a team of another name, so that there is something to find."""
    source = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cohort"))
    facts = entity_facts(spark, d).select("id", "name", "cohort", "team", "n_orders")
    scores = entity_scores(spark, d).where("id % 50 <> 3").select("id", "cohort", F.when(F.col("id") % 70 == 5, "moved").otherwise(F.col("team")).alias("team"), "n_orders")
    said = F.array_join(F.transform("differences", lambda x: F.concat(x["column"], F.lit("@"), x["stage"])), ",")
    return Q.lineage([("source", source), ("facts", facts), ("scores", scores)], "id").select("id", F.array_join("stages", ",").alias("stages"), "lost", "rows", said.alias("differences"))


@register("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o WHERE k <= 3)""")
def scoped_load(spark: SparkSession, d: str) -> DataFrame:
    """The first matches of each competition, and only their events."""
    from cohortry.operators.cohort import top_k

    o = top_k(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], 3)
    li = table(spark, d, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_semi").select("l_orderkey", "l_linenumber")
