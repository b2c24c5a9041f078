"""Registered queries: SQL agreement on the small tables, plans, and a skewed copy of the tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans.registry import QUERIES
from tests.oracle_check import TABLES, compare, connect

# one query per operator family keeps the suite short; tests/oracle_check.py runs all of them
SAMPLE = (
    "cohort_filter label_grid revisit_exists features_w1 features_w24_truncated_by_admission ecg_first_w6 dataset_multi_window qa_violations "
    "cohort_table interval_left_counts first_lab_pivot column_profile outliers_iqr_z quality_score ranking_metrics_by_group bootstrap_ci"
).split()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) == ""


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [n for n in QUERIES if re.match(r"op\d|pipeline", n)]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "deterioration_24h_from_w6" in df.columns


PLANS = "label_grid features_w6 interval_join_inner column_profile".split()


@pytest.mark.parametrize("name", PLANS)
def test_plans_have_no_cartesian_product_and_no_python(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = entry.queries()["cohort_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(event_type,signup)" in plan
    plan = entry.queries()["interval_left_unmatched"](spark, sf)._jdf.queryExecution().toString()
    assert "l_quantity" not in plan.split("Physical Plan")[-1]


@pytest.fixture(scope="module")
def skewed(spark, sf, tmp_path_factory):
    """Copy of the tables where one user holds a third of the events and one order a third of the lines."""
    base = tmp_path_factory.mktemp("skewed")
    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        if t == "events":
            df = df.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))
        if t == "lineitem":
            df = df.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, 7).otherwise(F.col("l_orderkey")))
        if t == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 5).otherwise(F.col("o_custkey")))
        df.coalesce(1).write.parquet(f"{base}/{t}.parquet")
    return str(base)


@pytest.mark.parametrize("name", ["label_grid", "features_w24", "ecg_first_w6", "first_lab_pivot", "range_history_counts"])
def test_hot_keys_change_nothing(spark, skewed, name):
    con = connect(skewed, "{t}.parquet/*.parquet")
    assert compare(entry.queries()[name](spark, skewed), con, entry.oracle_sql()[name]) == ""
