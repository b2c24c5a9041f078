import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import correlation
from tidemark.operators import profile as P
from tidemark.operators import qa as Q
from tidemark.operators.labels import build_labels
from tests.helpers import T0, US, h

COHORT = ("stay_id long, subject_id long, hadm_id long, ed_intime timestamp_ntz, ed_outtime timestamp_ntz, age_at_ed int, dod date")
LOG = "stay_id long, event_type string, event_time timestamp_ntz, source_table string"


def test_violations_are_found_and_info_is_separate(spark):
    cohort = spark.createDataFrame([(1, 1, 1, T0, h(5), 17, None), (2, 2, 2, T0, h(5), 50, T0.date()), (3, 3, 3, T0, h(5), 50, None)], COHORT)
    log = spark.createDataFrame([
        (1, "ICU_ADMIT", T0 - US, "s"), (2, "ACS", h(1), "s"), (3, "DEATH", h(1), "elsewhere"),
        (3, "ICU_ADMIT", h(2), "s"), (3, "ICU_ADMIT", h(9), "s")], LOG)
    labels = build_labels(cohort, log)
    broken = labels.withColumn("event_by_vent_w6", F.when(F.col("stay_id") == 2, -1).otherwise(F.col("event_by_vent_w6")))
    ecg = spark.createDataFrame([(1, h(5) + US), (2, h(5)), (3, None)], "stay_id long, ecg_time_w6 timestamp_ntz")
    got = {(r.check_name, r.severity): r.n for r in Q.qa_summary(Q.qa_violations(cohort, log, broken, ecg)).collect()}
    assert got == {
        ("events_before_ed", "ERROR"): 1, ("icd_events_with_time", "ERROR"): 1, ("death_wrong_source", "ERROR"): 1,
        ("event_by_monotonicity_vent", "ERROR"): 1, ("label_event_by_overlap_icu_w6", "INFO"): 1, ("age_out_of_bounds", "ERROR"): 1,
        ("dead_before_ed", "ERROR"): 1, ("ecg_outside_ed_window", "ERROR"): 1,
    }


@pytest.mark.parametrize("rows, schema, rate", [
    ([(1, 1.0, 10, 1.0, 0), (2, 2.0, 20, None, 0), (3, 3.0, 30, 1.0, 1), (4, 4.0, 40, None, 0), (5, 5.0, 50, 1.0, 1)],
     "stay_id int, feature1 double, feature2 int, feature3 double, y int", 0.4),
    ([(i, 0.5, int(i == 0)) for i in range(1000)], "stay_id int, feature1 double, y int", 0.001),
    ([(i, 0.5, int(i != 0)) for i in range(1000)], "stay_id int, feature1 double, y int", 0.999),
    ([(1, 0.5)], "stay_id int, feature1 double", None),
])
def test_dataset_metrics(spark, rows, schema, rate):
    df = spark.createDataFrame(rows, schema)
    r = Q.dataset_metrics(df).first()
    assert (r.n_rows, r.n_features) == (len(rows), len(df.columns) - 1)
    assert r.outcome_rate == (None if rate is None else pytest.approx(rate))


def test_empty_dataset(spark):
    assert Q.dataset_metrics(spark.createDataFrame([], "y int")).first().n_rows == 0
    with pytest.raises(ValueError):
        Q.dataset_checks(spark.createDataFrame([], ""))


def test_all_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None, 5, 0.0, 0), (2, 2.0, None, 5, None, 1)], "stay_id int, a double, b double, c int, d double, y int")
    got = {r.column_name: (r.all_null, r.constant) for r in Q.dataset_checks(df).collect()}
    assert got == {"b": (True, False), "c": (False, True), "d": (False, True)}
    one = spark.createDataFrame([(1, 0)], "stay_id int, y int")
    assert Q.dataset_checks(one).count() == 0  # ids and label are exempt


def test_column_profile_by_hand(spark):
    df = spark.createDataFrame([(1.0, 5, "a"), (2.0, 5, "a"), (4.0, 5, None), (None, 5, "b"), (9.0, None, "b")], "x double, c int, s string")
    got = {r.column_name: r for r in P.column_profile(df).collect()}
    x = got["x"]
    assert (x.n_missing, x.pct_missing, x.n_unique, x.q25, x["median"], x.q75, x.is_constant) == (1, 20.0, 4, 1.75, 3.0, 5.25, 0)
    assert x.std_value == pytest.approx(3.5590, abs=1e-4) and got["c"].is_constant == 1
    approx = {r.column_name: r for r in P.column_profile(df, approx=True).collect()}
    assert approx["x"].n_unique == 4 and set(approx["x"].asDict()) == set(x.asDict())
    counts = P.value_counts(df, ["s", "x"]).collect()
    assert sorted((r.column_name, r.value, r.n) for r in counts if r.n_distinct <= 3) == [("s", "a", 2), ("s", "b", 2)]
    assert {r.n_distinct for r in counts if r.column_name == "x"} == {4}
    m = P.missing_summary(df).first()
    assert (m.total_missing_cells, m.total_cells, m.columns_with_missing, m.columns_fully_complete) == (3, 15, 3, 0)


def test_outliers_and_guards(spark):
    rows = [(float(i % 10), float(i % 2), float(i)) for i in range(40)] + [(500.0, 1.0, None)]
    df = spark.createDataFrame(rows, "x double, two double, y double")
    got = {r.column_name: r for r in P.outliers(df).collect()}
    assert "two" not in got and got["x"].n_outliers_iqr == 1 and got["x"].n_outliers_zscore == 1 and got["y"].n_outliers_iqr == 0
    assert got["x"].few_values == 0 and P.outliers(df.limit(5), ["x"]).first().few_values == 1


def test_large_integers_keep_their_distinct_count(spark):
    df = spark.createDataFrame([(2**53 + i,) for i in range(6)], "k long")
    assert P.column_profile(df).first().n_unique == 6


def test_correlations_ignore_null_pairs_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 0), (2.0, 4.0, 1.0, 0), (3.0, None, 1.0, 1), (4.0, 8.0, 1.0, 1)], "a double, b double, k double, y int")
    got = [r.column_name for r in P.correlations_with(df, "y", ["a", "b", "k"]).collect()]
    assert set(got) == {"a", "b"}
    pairs = P.correlation_pairs(df, ["a", "b", "k"], 0.8).collect()
    assert [(r.feature1, r.feature2, round(r.correlation, 6)) for r in pairs] == [("a", "b", 1.0)]


def test_correlations_of_many_columns(spark):
    """Against the pairwise aggregate: NULLs, constants, far-off means, numbers that are not finite."""
    rng = random.Random(3)
    width = 40
    rows = []
    for i in range(300):
        base = [rng.gauss(0, 1) for _ in range(5)]
        rows.append(tuple(
            float("nan") if (c, i) == (8, 5) else None if c and rng.random() < 0.1 else 7.0 if c == 3 else 1e9 + base[c % 5] if c == 6 else base[c % 5] + 0.3 * rng.gauss(0, 1)
            for c in range(width)
        ))
    names = [f"c{c}" for c in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    plan = P.correlation_pairs(df, names)
    got = {(r.feature1, r.feature2): r.correlation for r in plan.collect()}
    assert len(got) == width * (width - 1) // 2
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    for pair in [("c0", "c5"), ("c0", "c6"), ("c1", "c2"), ("c38", "c39"), ("c6", "c11")]:
        want = df.agg(correlation(F.col(pair[0]), F.col(pair[1])).alias("r")).first().r
        assert abs(got[pair] - want) < 1e-6
    assert got["c0", "c3"] is None and math.isnan(got["c0", "c8"])
    assert {r.correlation for r in P.correlation_pairs(df.limit(0), names[:3]).collect()} <= {None}
    # a pair whose complete rows hold one value of a column that varies elsewhere
    part = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 4.0), (9.0, None)], "a double, b double")
    assert P.correlation_pairs(part, ["a", "b"]).first().correlation is None


def test_quality_score_rules(spark):
    score = lambda m, w, e, r=None: spark.range(1).select(P.quality_score(F.lit(m), F.lit(w), F.lit(e), F.lit(r)).alias("s")).first().s
    assert score(10.0, 1, 0, 0.2) == 93.0
    assert score(90.0, 0, 0, 0.2) == 80.0  # at most 20 points for missing cells
    assert score(0.0, 0, 1, 0.005) == 80.0 and score(0.0, 0, 0, 0.03) == 95.0
    assert score(0.0, 10, 20, 0.2) == 0.0


def test_sanity_checks(spark):
    df = spark.createDataFrame([(1, 17, 0, 300.0, None), (1, 40, 0, 80.0, None)], "stay_id int, age_at_ed int, y int, hr_mean_6h double, e double")
    got = {r.check_name: r.status for r in P.sanity_checks(df).collect()}
    assert got == {"unique_keys": "warn", "outcome_rate_bounds": "fail", "age_range": "warn", "range_hr_mean_6h": "warn", "all_null_columns": "fail"}


def test_feature_summary_parses_text(spark):
    df = spark.createDataFrame([("1", "a", 0), ("2", "b", 1), ("x", "a", 1), (None, "c", 0)], "n string, s string, y int")
    got = {r.column_name: r for r in P.feature_summary(df).collect()}
    assert (got["n"].is_numeric, got["n"].mean_value, got["n"].median_value, got["n"].n_missing) == (1, 1.5, 1.5, 1)
    assert got["s"].is_numeric == 0 and got["s"].mean_value is None and got["s"].top_values == "a(2); b(1); c(1)"


def test_bins_have_both_edge_rules(spark):
    df = spark.createDataFrame([(18,), (30,), (50,), (80,)], "a int")
    left = [r.x for r in df.select(P.binned(F.col("a"), P.AGE_EDGES, P.AGE_NAMES, right=False).alias("x")).collect()]
    right = [r.x for r in df.select(P.binned(F.col("a"), P.AGE_EDGES, P.AGE_NAMES).alias("x")).collect()]
    assert left == ["18-29", "30-49", "50-64", "80+"] and right == ["18-29", "18-29", "30-49", "65-79"]
    hist = P.time_histogram(spark.createDataFrame([(0.0,), (6.0,), (6.1,), (999.0,), (None,)], "t double"), F.col("t")).collect()
    assert [(r.bucket, r.n) for r in hist] == [("0-6h", 2), ("6-12h", 1), (">48h", 1)]
