"""The whole chain from events to claims on the random matches of test_marts."""

import pytest

from cohortry.operators import marts
from cohortry.plans import football as P
from test_marts import PEOPLE, TEAMS, expected_minutes, tables  # noqa: F401  (tables is a fixture)


@pytest.fixture(scope="module")
def chain(spark, tables):  # noqa: F811
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    # As in production, each mart is a table of its own.
    summary = marts.player_summary(*tables)
    summary = spark.createDataFrame(summary.collect(), summary.schema).coalesce(1)
    v = P.all_levels(summary)
    v = spark.createDataFrame(v.collect(), v.schema).coalesce(1)
    p = P.profiles(spark, v)
    yield v, spark.createDataFrame(p.collect(), p.schema).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_weights_sum_to_one():
    for w in [*P.WEIGHTS.values(), P.DEFENDER_SECURITY, P.ACTIVE, P.CONTROLLING]:
        assert sum(w.values()) == pytest.approx(1)


def test_rollups(chain):
    rows = {(r["player_id"], r["profile_type"]): r for r in chain[0].collect()}
    assert len(rows) == 3 * len(PEOPLE)
    for p, (team, position) in PEOPLE.items():
        local, season, career = (rows[p, k] for k in ("competition", "season", "career"))
        for r in (season, career):  # one competition: sums are its own
            assert r["minutes_played"] == local["minutes_played"] == expected_minutes(p) and r["goals_p90"] == local["goals_p90"] and r["pass_accuracy_pct"] == local["pass_accuracy_pct"]
            assert r["goals_minus_xg"] == pytest.approx(local["goals_minus_xg"], abs=2e-3) and r["total_passes"] == local["total_passes"]
            # Shots are rebuilt from expected goals and their mean by shot.
            assert r["shot_accuracy_pct"] == pytest.approx(local["shot_accuracy_pct"], abs=2)
        assert career["season"] == "Career" and career["team_name"] == TEAMS[team] and (season["position_group"] == "Unknown") == (position is None)


def test_profiles(chain):
    rows = chain[1].collect()
    assert len(rows) == 3 * len(PEOPLE)
    for r in rows:
        assert all(0 <= r[c] <= 100 for c in P.CAPABILITIES) and 0 <= r["display_rating"] <= 99.9 and "small_sample_warning" in r["decision_signals"]
        assert r["archetype"] in {n for _, n, *_ in P.ARCHETYPES} | {"Unknown", "Goalkeeper"} and r["role_family"] in P.ROLES and not r["sufficient_sample"]


def test_teams_graph_and_claims(spark, chain):
    teams = P.team_profiles(chain[1])
    means = {r["team_name"]: r for r in teams["means"].collect()}
    assert {t: r["squad_size"] for t, r in means.items()} == dict.fromkeys(TEAMS.values(), 2) and means["Harbour"]["grade"] != "N/A"
    assert {r["team_name"] for r in teams["fragility"].collect()} == set(TEAMS.values())
    nodes, edges = P.knowledge_graph(chain[1], teams)
    assert nodes.count() == len(PEOPLE) + len(TEAMS)
    kinds = {r["edge_type"]: r["count"] for r in edges.groupBy("edge_type").count().collect()}
    assert (kinds["HAS_CAPABILITY"], kinds["MEMBER_OF"], kinds["HAS_SQUAD_CAPABILITY"], kinds["FRAGILE_ON"]) == (36, 6, 18, 6)
    claims = P.player_claims(chain[1], "v1")
    assert claims.where("claim_type = 'capability'").count() == 36 and claims.select("claim_id").distinct().count() == claims.count()
    assert all(any(q.startswith("sample_size:") for q in r["qualifiers"]) for r in claims.collect())
    assert P.team_claims(teams).where("claim_type = 'identity'").count() == 3
    assert [r["profile_type"] for r in P.timeline(chain[1], 11).collect()][-1] in {"competition", "career"}


def test_categories_and_aliases(spark, chain):
    from cohortry.plans.aliases import PLAYERS, TEAMS, alias_table

    got = chain[1].select("position_group", P.statistic_category().alias("c"), P.capability_struct().alias("s")).collect()
    assert {r["c"] for r in got if r["position_group"] == "Winger"} == {"Attacker"} and all(r["s"]["weakest"] <= r["s"]["attacking_threat"] for r in got)
    assert len(PLAYERS) == 54 and len(TEAMS) == 75
    e = spark.createDataFrame([(1, "Lionel Andrés Messi Cuccittini"), (2, "Pedro González López"), (3, "Nobody")], "id long, name string")
    assert {(r["token"], r["key"]) for r in alias_table(spark, PLAYERS, e, "id", "name").collect()} == {("messi", 1), ("lionel messi", 1), ("pedri", 2)}
