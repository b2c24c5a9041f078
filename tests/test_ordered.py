import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import (
    RangeCount, exact_quantiles, last_at_or_before, next_at_or_after, positions, range_counts, running,
)

BASE = datetime(2024, 1, 1)


def skewed(n=600, seed=1):
    """(key, t, id): one key holds most rows."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(200), i) for i in range(n)]


def test_running_matches_brute_force_across_partitions(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t int, id int")
    out = running(df, ["k"], [F.col("t"), F.col("id")], {
        "s": ("sum", F.col("id").cast("long")), "lo": ("min", F.col("id")), "hi": ("max", F.struct("id", "t")),
    }, partitions=7).collect()
    assert len(out) == len(rows)
    for r in out:
        before = [x for x in rows if x[0] == r.k and (x[1], x[2]) <= (r.t, r.id)]
        assert r.s == sum(x[2] for x in before)
        assert r.lo == min(x[2] for x in before)
        assert r.hi.id == max(x[2] for x in before)


def test_hot_key_is_spread_over_partitions(spark):
    rows = [("hot", i, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(4)
    ranged = df.repartitionByRange(8, "k", "t").withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in ranged.groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 4000 / 4


def test_running_descending_and_without_key(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "x int")
    out = running(df, [], [F.col("x").desc()], {"n": ("sum", F.lit(1).cast("long"))}, partitions=5)
    assert {r.x: r.n for r in out.collect()} == {i: 50 - i for i in range(50)}


@pytest.mark.parametrize("lo_closed", [True, False])
@pytest.mark.parametrize("hi_closed", [True, False])
def test_range_counts_bounds(spark, lo_closed, hi_closed):
    rng = random.Random(3)
    at = lambda m: BASE + timedelta(minutes=m)
    facts = [(rng.choice("ab"), at(rng.randrange(60))) for _ in range(300)]  # many ties
    anchors = [(i, rng.choice("abc"), at(rng.randrange(60))) for i in range(40)]
    f = spark.createDataFrame(facts, "k string, t timestamp_ntz")
    a = spark.createDataFrame(anchors, "id int, k string, t timestamp_ntz")
    lo, hi = F.col("t") - F.expr("INTERVAL 10 MINUTES"), F.col("t")
    got = range_counts(a, "id", "k", {"f": (f, "t")}, {"n": RangeCount("f", lo, hi, lo_closed, hi_closed)})
    got = {r.id: r.n for r in got.collect()}
    for i, k, t in anchors:
        start = t - timedelta(minutes=10)
        n = sum(
            1 for fk, ft in facts
            if fk == k and (ft >= start if lo_closed else ft > start) and (ft <= t if hi_closed else ft < t)
        )
        assert got[i] == n


def test_next_at_or_after_takes_ties_and_none(spark):
    f = spark.createDataFrame([(1, BASE, 7), (1, BASE, 5), (1, BASE + timedelta(hours=2), 9), (1, None, 1)], "k int, t timestamp_ntz, id int")
    a = spark.createDataFrame(
        [(10, 1, BASE), (11, 1, BASE + timedelta(microseconds=1)), (12, 1, BASE + timedelta(hours=3)), (13, 2, BASE)],
        "aid int, k int, t timestamp_ntz")
    got = {r.aid: r.nearest and r.nearest.id for r in next_at_or_after(a, "aid", "k", "t", f, "t", ["id"]).collect()}
    assert got == {10: 5, 11: 9, 12: None, 13: None}


def test_last_at_or_before(spark):
    anchors = spark.createDataFrame([(1, BASE, 100), (1, BASE + timedelta(hours=5), 101), (2, BASE, 200)], "k int, s timestamp_ntz, aid int")
    facts = spark.createDataFrame(
        [(1, BASE - timedelta(seconds=1), "x"), (1, BASE, "y"), (1, BASE + timedelta(hours=5), "z"), (2, BASE + timedelta(days=9), "w")],
        "k int, t timestamp_ntz, v string")
    out = {r.v: r.anchor and r.anchor.aid for r in last_at_or_before(facts, "k", "t", anchors, "s", ["aid"]).collect()}
    assert out == {"x": None, "y": 100, "z": 101, "w": 200}


def test_positions_and_quantiles(spark):
    rows = [(k, v) for k, n in (("a", 101), ("b", 4), ("c", 1)) for v in range(n)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert {(r.k, r.v): r.position for r in positions(df, ["k"], [F.col("v")]).collect()} == {(k, v): v + 1 for k, v in rows}
    freq = df.groupBy("k", F.col("v").cast("double").alias("v")).count()
    q = {r.k: (r.q25, r.q50) for r in exact_quantiles(freq, ["k"], "v", "count", {"q25": 0.25, "q50": 0.5}).collect()}
    assert q == {"a": (25.0, 50.0), "b": (0.75, 1.5), "c": (0.0, 0.0)}
    whole = exact_quantiles(freq, [], "v", "count", {"q50": 0.5}).collect()
    # 106 values: 0 three times, 1..3 twice, 4..100 once; the two middle ones are 47 and 48
    assert whole[0].q50 == 47.5


def test_copies_of_one_fact_and_one_anchor(spark):
    """A third of all rows may be copies of each other: counts stay exact, ties are spread."""
    f = spark.range(900).select(F.lit("a").alias("k"), F.lit(BASE).cast("timestamp_ntz").alias("t"))
    a = spark.range(300).select(F.col("id"), F.lit("a").alias("k"), F.lit(BASE).cast("timestamp_ntz").alias("t"))
    t = F.col("t")
    got = range_counts(a, "id", "k", {"f": (f, "t")}, {"closed": RangeCount("f", t, t, True, True), "open": RangeCount("f", t, t, True, False)})
    assert {(r.closed, r.open) for r in got.collect()} == {(900, 0)} and got.count() == 300
    ties = running(a, [], [F.lit(1)], {"n": ("sum", F.lit(1).cast("long"))}, partitions=6)
    assert sorted(r.n for r in ties.collect()) == list(range(1, 301))


def test_totals_need_no_join_on_a_hot_group(spark):
    rows = [("hot", i % 50, float(i)) for i in range(600)] + [(f"k{i % 7}", i, 1.0) for i in range(60)] + [(None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = running(df, ["k"], [F.col("t"), F.col("v")], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, partitions=6, totals=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        want = {}
        for k, _, v in rows:
            s, m, n = want.get(k, (0.0, v, 0))
            want[k] = (s + v, max(m, v), n + 1)
        got = out.collect()
        assert len(got) == len(rows) and all((r.s_total, r.m_total, r.n_rows) == want[r.k] for r in got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
