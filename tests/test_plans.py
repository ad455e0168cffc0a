"""Properties of the physical plans of all core queries."""

import re

import pytest

from cohortry.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["match_summary", "entity_summary_fused", "percentiles_in_cohort", "candidates", "hhi", "fragility", "replacements", "graph_edges", "claims", "resolve_mentions", "dq_report", "season_rollup"])
def test_no_python_and_no_product(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|MapInArrow|CartesianProduct", text)


@pytest.mark.parametrize("name", ["hhi", "fragility", "graph_edges", "claims", "percentiles_in_cohort", "calibration_quantiles"])
def test_no_python_before_the_cuts(spark, monkeypatch, name):
    """The same over the frames that a query would write first: its plan reaches the tables."""
    for module in ("plans.base", "plans.cohort_queries", "plans.score_queries", "plans.graph_text_queries", "operators.cohort", "operators.scoring", "operators.teams"):
        monkeypatch.setattr(f"cohortry.{module}.stored", lambda df: df, raising=False)
    text = plan(Q.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|MapInArrow|CartesianProduct|ExistingRDD", text)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("l_orderkey" in s for s in scans) and all("l_comment" not in s and "o_totalprice" not in s for s in scans)


def test_scans_read_few_columns_and_push_filters(spark):
    text = plan(Q.QUERIES["entity_summary_fused"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("l_extendedprice" not in s and "o_totalprice" not in s for s in schemas)
    assert "EqualTo(c_mktsegment,BUILDING)" in plan(Q.QUERIES["filtered_entities"](spark, SF))


def test_player_facts_scan_events_once(spark):
    from cohortry.operators.marts import player_match_facts
    from test_marts import EVENT

    text = plan(player_match_facts(spark.createDataFrame([], EVENT)))
    assert text.count("Scan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(Q.QUERIES["topn_candidates"](spark, SF)) or "WindowGroupLimit" in plan(Q.QUERIES["dedup_first"](spark, SF))


def test_filtered_entities_keeps_every_team(spark):
    """No team is left out: F1 of round 3."""
    from pyspark.sql import functions as F

    from cohortry.plans.base import entity_facts

    wanted = (F.col("cohort") == "BUILDING") & (F.col("n_orders") >= 5) & (F.col("name").contains("1") | F.col("exposure").between(100, 400))
    got = {r["id"]: r["team"] for r in Q.QUERIES["filtered_entities"](spark, SF).collect()}
    assert got == {r["id"]: r["team"] for r in entity_facts(spark, SF).where(wanted).collect()}
    assert {"NATION_3", "NATION_14"} & set(got.values())
