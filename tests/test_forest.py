"""Forests over packed blocks against Spark ML's on the same rows."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tidemark.operators import boosting as B
from tidemark.operators import forest as R
from tidemark.operators import model as M


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(5))
        rows.append((i, Vectors.dense(a, 0.0, b, c, rng.gauss(0, 1)), int(a + b * (c > 2) + rng.gauss(0, 0.7) > 0.3)))
    return spark.createDataFrame(rows, ["stay_id", "features", "y"]).repartition(3).cache()


def probabilities(model, df):
    return np.array([r.p for r in model.transform(df).orderBy("stay_id").select(vector_to_array("probability")[1].alias("p")).collect()])


def test_without_draws_the_trees_are_spark_mls(table, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 700)
    monkeypatch.setattr(B, "CHUNK_ROWS", 256)
    monkeypatch.setattr(R, "CHUNK_ROWS", 256)
    theirs = RandomForestClassifier(labelCol="y", numTrees=2, maxDepth=5, bootstrap=False, featureSubsetStrategy="all", seed=7).fit(table)
    ours = R.fit_forest(table, "y", table.count(), 2, 5, seed=7, bootstrap=False, features=5)
    assert ours.getNumTrees == 2
    assert probabilities(ours, table) == pytest.approx(probabilities(theirs, table), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)


def test_large_tables_get_every_tree_over_blocks(table, monkeypatch):
    theirs, other = (M.random_forest(60, 5, seed)(table, "y") for seed in (42, 43))
    monkeypatch.setattr(M, "BLOCKED_ROWS", 1000)
    monkeypatch.setattr(R, "SUMS_MB", 1)
    ours, again = (M.random_forest(60, 5)(table, "y") for _ in range(2))
    assert isinstance(ours, R.ForestModel) and ours.getNumTrees == 60 and len({tuple(t.feature) for t in ours.trees}) > 50
    # a third of the features each, drawn anew for each node
    assert len({int(t.feature[0]) for t in ours.trees}) >= 3
    p, q = probabilities(ours, table), probabilities(theirs, table)
    assert (p == probabilities(again, table)).all()
    assert np.abs(p - q).mean() < 1.5 * np.abs(probabilities(other, table) - q).mean()
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.06)


def test_only_sums_over_all_rows_reach_the_driver(table, monkeypatch):
    seen, grow = [], R.grow
    monkeypatch.setattr(R, "grow", lambda tree, level, sums, *a: (seen.append((level, sums.shape, int(sums[0].sum()))), grow(tree, level, sums, *a)))
    R.fit_forest(table, "y", 4000, 3, 3, bootstrap=False)
    assert seen == [(level, (5, 2**level, 2, B.BINS), 4000) for level in range(3) for _ in range(3)]


def test_copies_of_a_row_are_poisson():
    copies = R.copies_by_draw()
    assert len(copies) == 2**16 and copies.mean() == pytest.approx(1, abs=1e-3) and copies.var() == pytest.approx(1, abs=2e-3)
    drawn = copies.take(R.draws(42, 3, 5, 30_001))
    assert len(drawn) == 30_001 and drawn.mean() == pytest.approx(1, abs=0.03)
    assert (R.draws(42, 3, 5, 30_001) != R.draws(42, 4, 5, 30_001)).any()


def test_tables_without_a_split(spark, table):
    flat = table.drop("features").join(spark.createDataFrame([(Vectors.dense(1.0, 2.0),)], ["features"]), how="cross")
    model = R.fit_forest(flat, "y", 4000, 2, 3, bootstrap=False)
    assert model.featureImportances.toArray().tolist() == [0.0, 0.0]
    assert model.positives(np.array([[1.0, 2.0]]))[0] == pytest.approx(sum(r.y for r in table.collect()) / 4000)
