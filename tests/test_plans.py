"""Physical-plan properties of the registered queries."""

import pytest

from querylab.plans.registry import load_all

REG = load_all()


def plan(spark, sf_dir, name):
    df = REG[name].run(spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["J1_fk_join", "J2_fk_chain_3", "J3_multi_edge_join", "J4_self_join_on_key",
                                  "J5_fk_plus_self_join", "J6_non_fk_equi_join", "J8_band_join",
                                  "R0_revenue_by_nation_top10"])
def test_no_cartesian_or_nested_loop(spark, sf_dir, name):
    p = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


@pytest.mark.parametrize("name,join", [("Q1_in_subquery", "LeftSemi"), ("Q4_exists", "LeftSemi"),
                                       ("Q5_not_exists", "LeftAnti"), ("Q2_not_in_subquery", "LeftAnti"),
                                       ("F8_and_or_with_subquery", "ExistenceJoin")])
def test_subqueries_become_semi_anti_existence_joins(spark, sf_dir, name, join):
    p = plan(spark, sf_dir, name)
    assert join in p
    assert "NestedLoopJoin" not in p


def test_flagship_pushdown_and_pruning(spark, sf_dir):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")   # plan text is otherwise truncated
    try:
        df = REG["R0_revenue_by_nation_top10"].run(spark, sf_dir)
        p = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "GreaterThanOrEqual(l_shipdate" in p and "GreaterThanOrEqual(l_quantity,5.0)" in p
    # Columns the query does not use are never read.
    for unused in ("l_tax", "l_returnflag", "l_linestatus", "l_partkey", "o_orderpriority", "c_acctbal"):
        assert unused not in p


@pytest.mark.parametrize("name", ["C13_quota_fill", "C14_stratified_sample"])
def test_top_k_per_group_limits_before_shuffle(spark, sf_dir, name):
    df = REG[name].run(spark, sf_dir)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_exact_match_is_a_condition_on_a_row(spark, sf_dir):
    assert "Exchange" not in plan(spark, sf_dir, "E14_exact_match")
