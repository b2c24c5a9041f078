import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as V


def brute(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for cut in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(p >= cut for p in pos)
        ap += (tp - seen) / len(pos) * tp / (tp + sum(n >= cut for n in neg))
        seen = tp
    return auroc, ap


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(12) / 10, int(rng.random() < 0.3)) for g in ("a", "b") for _ in range(200)]
    got = {r.g: r for r in V.ranking_metrics(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", ["g"]).collect()}
    for g in ("a", "b"):
        auroc, ap = brute([(s, y) for k, s, y in rows if k == g])
        assert got[g].auroc == pytest.approx(auroc) and got[g].average_precision == pytest.approx(ap)


def test_degenerate_groups(spark):
    df = spark.createDataFrame([("one", 0.1, 1), ("one", 0.2, 1), ("none", 0.2, 0), ("same", 0.5, 0), ("same", 0.5, 1)], "g string, s double, y int")
    got = {r.g: (r.auroc, r.average_precision) for r in V.ranking_metrics(df, "s", "y", ["g"]).collect()}
    assert got == {"one": (None, 1.0), "none": (None, 0.0), "same": (0.5, 0.5)}
    assert V.ranking_metrics(df.where("false"), "s", "y").count() == 0


def test_weights_equal_repeated_rows(spark):
    df = spark.createDataFrame([(0.1, 0, 3), (0.4, 1, 2), (0.4, 0, 1), (0.9, 1, 1)], "s double, y int, w int")
    repeated = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("w"))))
    a, b = V.ranking_metrics(df, "s", "y", weight="w").first(), V.ranking_metrics(repeated, "s", "y").first()
    assert a == b


def test_threshold_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.2, 1), (0.6, 0), (0.1, 0)], "s double, y int")
    r = V.threshold_metrics(df, "s", "y").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)
    assert r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(2 / 3) and r.specificity == 0.5
    assert r.brier == pytest.approx((0.01 + 0.25 + 0.64 + 0.36 + 0.01) / 5)
    none = V.threshold_metrics(df.where("y = 1 AND s < 0.5"), "s", "y").first()
    assert (none.precision, none.specificity) == (0.0, 0.0)


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    assert V.kappa(df, "a", "b").first().kappa == pytest.approx(0.4)


def test_folds_and_samples(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 40).alias("g"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    folds = V.stratified_folds(df, "k", "y").join(df, "k")
    assert {r["count"] for r in folds.groupBy("fold", "y").count().where("y = 1").collect()} == {20}
    assert df.select("g", V.group_fold("g").alias("f")).distinct().count() == 40
    picked = V.stratified_sample(df, "k", "y", 101)
    assert sorted((r.y, r["count"]) for r in picked.groupBy("y").count().collect()) == [(0, 91), (1, 10)]
    a, b = ({r.k for r in V.sample(d, "k", 7).collect()} for d in (df, df.repartition(5)))
    assert a == b and len(a) == 7  # independent of how the rows are partitioned


def test_shuffled_labels_keep_the_class_counts(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") < 30).cast("int").alias("y"))
    out = V.shuffled_labels(df, "k", "y").collect()
    assert len({r.k for r in out}) == 200 and sum(r.y for r in out) == 30
    assert sum(r.y for r in out if r.k < 30) < 30


def test_bootstrap_interval_holds_the_point(spark):
    rng = random.Random(2)
    rows = [(i % 60, min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * (i % 3 == 0), 0.2))), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    for r in V.bootstrap_ci(df, "g", "s", "y", replicates=60).collect():
        assert r.low < r.point < r.high


def test_samples_take_the_smallest_hashes(spark):
    """Against a full order, for sizes around those of a hash prefix; the plan orders no more than one prefix."""
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("s"))
    keyed = sorted((r.h, r.id, r.s) for r in df.select("id", "s", V.hash_key(["id"], 42).alias("h")).collect())
    for n in (0, 1, 7, 500, 8999, 9000, 20000):
        assert {r.id for r in V.sample(df, "id", n).collect()} == {i for _, i, _ in keyed[:n]}
    sizes = {s: sum(x[2] == s for x in keyed) for s in "abc"}
    for n in (0, 10, 900, 9000):
        want = {i for s, m in sizes.items() for _, i, _ in [x for x in keyed if x[2] == s][: int(n * m / 9000 + 0.5)]}
        assert {r.id for r in V.stratified_sample(df, "id", "s", n).collect()} == want


def test_replicates_are_weighted_metrics(spark):
    """Against the weighted metrics of cells repeated for every replicate; many equal scores, a hot score, NULL clusters."""
    rng = random.Random(5)
    rows = [(rng.randrange(40) if i % 11 else None, 0.5 if i % 3 == 0 else rng.randrange(12) / 12, int(rng.random() < 0.3)) for i in range(400)]
    rows += [(1, None, 1), (2, 0.3, None)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    known = df.where("s is not null and y is not null")
    drawn = known.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(25)))).withColumn("w", V.poisson_weight("g", "replicate", 9))
    want = {r.replicate: r for r in V.ranking_metrics(drawn.where("w > 0"), "s", "y", ["replicate"], "w").collect()}
    plan = V.bootstrap_replicates(df, "g", "s", "y", 25, 9)
    got = {r.replicate: r for r in plan.collect()}
    assert set(got) == set(want) == set(range(1, 26))
    for k, r in want.items():
        assert (got[k].n_pos, got[k].n_neg) == (r.n_pos, r.n_neg)
        assert abs(got[k].auroc - r.auroc) < 1e-9 and abs(got[k].average_precision - r.average_precision) < 1e-9
    assert V.bootstrap_replicates(df.limit(0), "g", "s", "y", 25, 9).count() == 0


def test_poisson_weights(spark):
    df = spark.range(20000).select(F.col("id"), F.lit(3).alias("r"))
    r = df.select(V.poisson_weight("id", "r", 1).alias("w")).agg(F.avg("w").alias("m"), F.variance("w").alias("v")).first()
    assert abs(r.m - 1) < 0.03 and abs(r.v - 1) < 0.05


def test_missingness_delta(spark):
    a = spark.createDataFrame([(1, None), (2, 1)], "k int, x int")
    b = spark.createDataFrame([(1, 1)], "k int, x int")
    r = V.missingness_delta(a, b, ["x"]).first()
    assert (r.pct_a, r.pct_b, r.delta) == (50.0, 0.0, -50.0)
