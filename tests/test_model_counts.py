"""Trees and iterations of the registered fits, read from fitted models."""

import random

import pytest
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators import model as M
from tidemark.plans import catalog_models as C


class Found(Exception):
    pass


@pytest.fixture(scope="module")
def tiny(spark):
    rng = random.Random(1)
    rows = [(i, i % 40, Vectors.dense(rng.gauss(0, 1), rng.gauss(0, 1)), int(rng.random() < 0.5)) for i in range(200)]
    return spark.createDataFrame(rows, ["stay_id", "subject_id", "features", "y"]).repartition(1).cache()


def fit_of(monkeypatch, query):
    """The fit that a query hands to cross-validation or to the importance ranking."""
    held = []

    def take(*args, **kw):
        held.append(next(a for a in args if callable(a) and not isinstance(a, type)))
        raise Found

    for name in ("cross_validate", "compare", "multi_label", "scored_variants", "scored_labels", "feature_importance", "shuffled_control", "leakage_experiment"):
        monkeypatch.setattr(M, name, take)
    monkeypatch.setattr(C, "orders_table", lambda t: None)
    with pytest.raises(Found):
        query(None)
    return held[0]


@pytest.mark.parametrize("query", [C.logistic_cv, C.incremental_value, C.shuffled_control, C.result_table, C.logistic_cv_frame, C.incremental_value_frame])
def test_logistic_fits_may_take_a_thousand_steps(monkeypatch, tiny, query):
    model = fit_of(monkeypatch, query)(tiny, "y")
    assert isinstance(model, LogisticRegressionModel) and model.getMaxIter() == 1000


def test_the_forest_has_two_hundred_trees(monkeypatch, tiny):
    model = fit_of(monkeypatch, C.multi_label_forest)(tiny, "y")
    assert isinstance(model, RandomForestClassificationModel) and model.getNumTrees == 200 and model.getMaxDepth() == 5


def test_boosting_ends_early_on_noise(monkeypatch, tiny):
    model = fit_of(monkeypatch, C.boosted_trees_cv)(tiny, "y")
    assert isinstance(model, GBTClassificationModel) and model.getMaxIter() == 500 and model.getNumTrees < 60
    assert (model.getMaxDepth(), model.getMinInstancesPerNode()) in M.BOOSTING_GRID


def test_boosting_goes_on_while_it_gains(tiny):
    labelled = tiny.withColumn("y", (F.col("stay_id") % 2).cast("int")).withColumn("_v", F.col("subject_id") % 5 == 0)
    signal = M.VectorAssembler(inputCols=["y"], outputCol="features").transform(labelled.drop("features"))
    noise = M.boosted_trees(30, 2, 0.05, "_v")(labelled, "y")
    clear = M.boosted_trees(30, 2, 0.05, "_v")(signal, "y")
    assert noise.getNumTrees < 30 == clear.getNumTrees


def test_fifty_thousand_categories(spark):
    rows = spark.range(50_000).select(F.col("id").alias("stay_id"), F.format_string("c%05d", F.col("id")).alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    prep = M.fit_preparation(rows, ["k"], scale=False)
    other = rows.limit(3).unionByName(spark.createDataFrame([(-1, "zzz", 0), (-2, None, 1)], "stay_id long, k string, y int"))
    coded = prep.apply(rows).select("stay_id", M.vector_to_array("features")[0].alias("x"))
    assert coded.where(F.col("x") != F.col("stay_id")).count() == 0 and coded.count() == 50_000
    got = {r["stay_id"]: r["x"] for r in prep.apply(other).select("stay_id", M.vector_to_array("features")[0].alias("x")).collect()}
    assert got[-1] == got[-2] == 0.0 and len(got) == 5


def test_grid_fits_read_few_partitions_of_vectors(monkeypatch, tiny):
    seen = []
    monkeypatch.setattr(M, "boosted_trees", lambda *a, f=M.boosted_trees: lambda train, label: (seen.append(train), f(2, *a[1:])(train, label))[1])
    wide = tiny.repartition(6).withColumn("other", F.lit("text"))
    M.boosted_grid()(wide, "y")
    assert len(seen) == len(M.BOOSTING_GRID) and {t.rdd.getNumPartitions() for t in seen} == {1}
    assert seen[0].columns == ["features", "y", "_validation"]
