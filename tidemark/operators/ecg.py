"""Features of the first ECG inside a window; ECGs know their subject, not their stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import next_at_or_after
from tidemark.functions.timeops import hours_between, window_end

_RAW = ("p_onset", "p_end", "qrs_onset", "qrs_end", "t_end", "p_axis", "qrs_axis", "t_axis")


def first_ecg(cohort: DataFrame, studies: DataFrame, hours: float) -> DataFrame:
    """(stay_id, study_id, ecg_time) of the first study on [t_in, min(t_out, t_in + P)].

    The first study at or after arrival is found by one ordered scan per
    subject; it is the first in the window exactly if it lies inside.
    """
    found = next_at_or_after(cohort, "stay_id", "subject_id", "ed_intime", studies, "ecg_time", ["study_id"])
    return (
        cohort.select("stay_id", "ed_intime", "ed_outtime").join(found, "stay_id")
        .where(F.col("nearest.time") <= window_end("ed_intime", "ed_outtime", hours))
        .select(
            "stay_id",
            F.col("nearest.study_id").alias("study_id"),
            F.col("nearest.time").alias("ecg_time"),
            hours_between("ed_intime", "nearest.time").alias("hours_from_ed"),
        )
    )


def build_ecg_features(
    cohort: DataFrame, studies: DataFrame, measurements: DataFrame, hours: float, window: str
) -> DataFrame:
    """One row per anchor with intervals, axes and a missing flag."""
    m = measurements.select("study_id", "rr_interval", *_RAW)
    wide = (
        cohort.select("stay_id")
        .join(first_ecg(cohort, studies, hours), "stay_id", "left")
        .join(m, "study_id", "left")
    )
    diff = lambda a, b: F.col(a) - F.col(b)
    cols = {
        "ecg_study_id": F.col("study_id"),
        "ecg_time": F.col("ecg_time"),
        "ecg_hours_from_ed": F.col("hours_from_ed"),
        "ecg_hr": F.when(F.col("rr_interval") > 0, F.lit(60000.0) / F.col("rr_interval")),
        "ecg_rr_interval": F.col("rr_interval"),
        "ecg_qrs_dur": diff("qrs_end", "qrs_onset"),
        "ecg_pr": diff("qrs_onset", "p_onset"),
        "ecg_qt": diff("t_end", "qrs_onset"),
        **{f"ecg_{c}": F.col(c) for c in _RAW},
        "missing_ecg": F.col("study_id").isNull().cast("int"),
    }
    return wide.select("stay_id", *[e.alias(f"{n}_{window}") for n, e in cols.items()])


def ecg_profile(ecg: DataFrame, window: str) -> DataFrame:
    """Coverage and heart rate / QRS statistics in one row (medians are separate)."""
    has = F.col(f"missing_ecg_{window}") == 0
    hr, qrs = f"ecg_hr_{window}", f"ecg_qrs_dur_{window}"
    return ecg.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(has).alias("n_with_ecg"),
        F.avg(has.cast("double")).alias("coverage"),
        F.avg(hr).alias("mean_hr"), F.min(hr).alias("min_hr"), F.max(hr).alias("max_hr"),
        F.avg(qrs).alias("mean_qrs"),
    )


def coverage_by(labels: DataFrame, ecg: DataFrame, outcome: str, window: str) -> DataFrame:
    """ECG coverage per outcome value."""
    has = F.col(f"missing_ecg_{window}") == 0
    return (
        labels.select("stay_id", F.col(outcome).alias("y"))
        .join(ecg.select("stay_id", f"missing_ecg_{window}"), "stay_id")
        .groupBy("y")
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(has).alias("n_with_ecg"),
            F.avg(has.cast("double")).alias("coverage"),
        )
    )
