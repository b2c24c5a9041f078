"""Time arithmetic on zone-free timestamps, and the anchored interval join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US_PER_HOUR = 3_600_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def hours_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(float(US_PER_HOUR))


def add_hours(ts: Column | str, hours: Column | float) -> Column:
    """Shift by a constant or a column of fractional hours, to the microsecond."""
    if isinstance(hours, (int, float)):
        micros = F.lit(round(hours * US_PER_HOUR)).cast("long")
    else:
        micros = F.round(hours * F.lit(float(US_PER_HOUR))).cast("long")
    return F.timestamp_add("MICROSECOND", micros, _col(ts))


def window_end(t_in: Column | str, t_out: Column | str, hours: float) -> Column:
    """End of the closed feature window: P hours in, but never past departure."""
    return F.least(_col(t_out), add_hours(t_in, hours))


def epoch_micros(ts: Column | str) -> Column:
    return micros_between(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def time_bucket(ts: Column | str, hours: float) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(hours * US_PER_HOUR)).cast("long")


def interval_join(
    anchors: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    how: str = "inner",
    bucket_hours: float | None = None,
) -> DataFrame:
    """Join facts to anchors on ``keys`` where ``start <= time <= end``.

    The plain form is an equi join with a range residual, right when a key has
    few anchors (a stay, an admission). With ``bucket_hours`` the time bucket
    joins the hash key, so that a key with many anchors and many facts (a
    subject) compares only rows near each other in time: each anchor is repeated
    for every bucket its interval touches, each fact lives in one bucket, and
    no pair can appear twice.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, got {how}")
    a, f = anchors.alias("a"), facts.alias("f")
    equal = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"f.{k}") for k in keys])
    in_range = F.col(f"f.{time}").between(F.col(f"a.{start}"), F.col(f"a.{end}"))
    fact_cols = [F.col(f"f.{c}") for c in facts.columns if c not in keys]
    if bucket_hours is None:
        return a.join(f, equal & in_range, how).select("a.*", *fact_cols)

    if how == "left":
        raise ValueError("the bucketed form is inner only; left join its result by anchor id")
    a = anchors.withColumn(
        "_bucket",
        F.explode(
            F.sequence(time_bucket(start, bucket_hours), time_bucket(end, bucket_hours))
        ),
    ).where(F.col(start) <= F.col(end)).alias("a")
    f = facts.withColumn("_bucket", time_bucket(time, bucket_hours)).alias("f")
    joined = a.join(f, equal & (F.col("a._bucket") == F.col("f._bucket")) & in_range)
    return joined.select("a.*", *fact_cols).drop("_bucket")
