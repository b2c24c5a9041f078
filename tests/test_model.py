import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import model as M


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(0)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        rows.append((i, i % 60, y + rng.gauss(0, 0.4), rng.gauss(0, 1) if i % 5 else None, rng.choice("ab") if i % 7 else None, y))
    return spark.createDataFrame(rows, "stay_id int, subject_id int, signal double, noise double, kind string, y int").cache()


def test_feature_columns_skip_ids_and_outcomes(data):
    assert M.feature_columns(data.withColumn("y_x", F.lit(1)).withColumn("chiefcomplaint", F.lit("a"))) == ["signal", "noise", "kind"]


def test_preparation_is_fitted_on_training_rows_only(spark):
    train = spark.createDataFrame([(1, 1.0, "b", 0), (2, 3.0, "a", 1), (3, None, None, 1)], "stay_id int, x double, k string, y int")
    test = spark.createDataFrame([(4, None, "zzz", 0), (5, 100.0, "b", 0)], "stay_id int, x double, k string, y int")
    prep = M.fit_preparation(train, ["x", "k"], scale=False)
    assert prep.medians == {"x": 2.0}
    got = {r.stay_id: r.f for r in prep.apply(test).select("stay_id", vector_to_array("features").alias("f")).collect()}
    # codes in sorted order: _missing_, a, b; an unseen value becomes 0
    assert got == {4: [2.0, 0.0], 5: [100.0, 2.0]}
    scaled = M.fit_preparation(train, ["x"]).apply(train).select(vector_to_array("features").alias("f")).collect()
    assert sum(r.f[0] for r in scaled) == pytest.approx(0)


def test_empty_column_gets_zero(spark):
    df = spark.createDataFrame([(1, None, 1.0, 0), (2, None, 2.0, 1)], "stay_id int, e double, x double, y int")
    assert M.fit_preparation(df, ["e", "x"], scale=False).medians == {"e": 0.0, "x": 1.5}


def test_cross_validation_finds_the_signal_and_not_the_noise(data):
    scores = M.cross_validate(data, ["signal", "kind"], M.logistic(1.0, 30), k=3)
    assert scores.count() == data.count()
    assert scores.groupBy("subject_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    per_fold = M.cv_metrics(scores).collect()
    assert len(per_fold) == 3 and all(r.auroc > 0.8 for r in per_fold)
    control = M.shuffled_control(data, ["signal", "kind"], M.logistic(1.0, 30), k=3).first()
    assert 0.3 < control.auroc_mean < 0.7


def test_compare_delta_and_importance(data):
    out = M.with_delta(M.compare(data, {"noise": ["noise"], "both": ["noise", "signal"]}, M.logistic(1.0, 20), k=2), "noise")
    got = {r.variant: r for r in out.collect()}
    assert got["noise"].delta_auroc == 0.0 and got["both"].delta_auroc > 0.1 and got["both"].n_features == 2
    top = M.feature_importance(data, ["noise", "signal"], M.boosted_trees(5, 2, 0.3)).first()
    assert top.feature == "signal"


def test_tuning_refits_a_grid_entry(data):
    grid = {"weak": M.logistic(1e-4, 10), "strong": M.logistic(10.0, 20)}
    prep = M.fit_preparation(data, ["signal"])
    model = M.tuned(grid)(prep.apply(data), "y")
    assert model.coefficients.size == 1


def test_ablation_sets_grow():
    sets = M.ablation_sets(["age_at_ed", "gender", "sbp_min_6h", "lactate_first_6h", "missing_lactate_6h", "ed_los_hours"])
    assert [len(v) for v in sets.values()] == [2, 3, 4, 5, 6]
    assert list(sets)[0] == "demographics" and sets["+missing"][-1] == "missing_lactate_6h"


def plain_median(values):
    values = sorted(v for v in values if v is not None)
    return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2 if values else 0.0


def test_medians_of_all_folds_come_from_one_ordered_scan(spark, monkeypatch):
    rng = random.Random(5)
    # "far" has a median outside fold 0 that lies far from the one over all rows; "ties" repeats few values
    rows = [(i % 3, rng.gauss(0, 1) if i % 4 else None, float(rng.randrange(3)), 1e6 + i if i % 3 == 0 else float(i), None, rng.choice("abc") if i % 3 else "z") for i in range(600)]
    rows += [(0, None, None, 2e6 + i, None, None) for i in range(500)]
    df = spark.createDataFrame(rows, "fold int, x double, ties double, far double, empty double, kind string")
    scans = []
    monkeypatch.setattr(M, "running", lambda d, *a, f=M.running, **k: (scans.append(1), f(d, *a, **k))[1])
    preps = M.fit_preparations(df, ["x", "ties", "kind"], range(3), scale=False)
    assert len(scans) <= 2
    preps_far = M.fit_preparations(df, ["far", "empty"], range(3), scale=False)
    for i in range(3):
        own = [r for r in rows if r[0] != i]
        got = preps[i].medians | preps_far[i].medians
        want = {c: plain_median([r[j] for r in own]) for j, c in enumerate(["x", "ties", "far", "empty"], 1)}
        assert got == pytest.approx(want)
        kinds = sorted({r[5] or M.MISSING for r in own})
        assert {r["value"]: r["code"] for r in preps[i].codes.collect()} == {v: float(n) for n, v in enumerate(kinds)}


def test_variants_share_folds_and_give_the_scores_of_single_runs(data):
    sets = {"noise": ["noise"], "both": ["kind", "noise", "signal"]}
    each = M.cross_validate_each(data, sets, M.logistic(1.0, 20), k=2)
    for name, columns in sets.items():
        alone = {r.stay_id: r.score for r in M.cross_validate(data, columns, M.logistic(1.0, 20), k=2).collect()}
        assert {r.stay_id: r.score for r in each[name].collect()} == pytest.approx(alone)
