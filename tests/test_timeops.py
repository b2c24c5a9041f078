from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.timeops import add_hours, hours_between, interval_join, window_end
from tests.helpers import T0, US, h


def test_hours_and_shift_are_exact(spark):
    df = spark.createDataFrame([(T0, h(1.5) + US)], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(
        hours_between("a", "b").alias("h"), add_hours("a", 0.5).alias("x"), add_hours("a", hours_between("a", "b")).alias("y"),
        window_end("a", "b", 6).alias("e"), (F.lit(datetime(2024, 2, 29)).cast("timestamp_ntz") - F.expr("INTERVAL 1 YEAR")).alias("leap"),
    ).first()
    assert r.h > 1.5 and r.x == h(0.5) and r.y == h(1.5) + US and r.e == h(1.5) + US
    assert r.leap == datetime(2023, 2, 28)


def test_interval_join_is_closed_and_bucketing_changes_nothing(spark):
    anchors = spark.createDataFrame([(1, "a", T0, h(6)), (2, "a", h(5), h(30)), (3, "b", T0, h(1)), (4, "a", h(9), h(8))],
                                    "id int, k string, s timestamp_ntz, e timestamp_ntz")
    times = [T0 - US, T0, h(6), h(6) + US, h(30), h(30) + US, h(8.5)]
    facts = spark.createDataFrame([(k, t, i) for k in "ab" for i, t in enumerate(times)], "k string, t timestamp_ntz, f int")
    pairs = lambda df: sorted((r.id, r.f) for r in df.collect())
    plain = pairs(interval_join(anchors, facts, ["k"], "t", "s", "e"))
    assert plain == [(1, 1), (1, 2), (2, 2), (2, 3), (2, 4), (2, 6), (3, 1)]
    for width in (0.5, 6, 100):
        assert pairs(interval_join(anchors, facts, ["k"], "t", "s", "e", bucket_hours=width)) == plain


def test_left_interval_join_keeps_unmatched(spark):
    anchors = spark.createDataFrame([(1, "a", T0, h(1)), (2, "z", T0, h(1))], "id int, k string, s timestamp_ntz, e timestamp_ntz")
    facts = spark.createDataFrame([("a", T0 + timedelta(days=1), 1)], "k string, t timestamp_ntz, f int")
    out = interval_join(anchors, facts, ["k"], "t", "s", "e", "left").collect()
    assert sorted((r.id, r.f) for r in out) == [(1, None), (2, None)]
