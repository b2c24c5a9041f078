"""Integrity checks as violation rows, and one-row consistency reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.reshape import long_form
from tidemark.functions.timeops import hours_between
from tidemark.operators.labels import event_by_name

EVENT_NAMES = (*R.TIMED_EVENTS, "deterioration")


def _failed(df: DataFrame, checks: Mapping[str, tuple[str, Column, Column]]) -> DataFrame:
    """(check_name, severity, stay_id, detail) for every check a row fails; one pass for all checks."""
    items = [
        F.when(bad, F.struct(F.lit(n).alias("check_name"), F.lit(sev).alias("severity"), detail.cast("string").alias("detail")))
        for n, (sev, bad, detail) in checks.items()
    ]
    return df.select("stay_id", F.explode(F.array_compact(F.array(*items))).alias("x")).select(
        "x.check_name", "x.severity", "stay_id", "x.detail"
    )


def qa_violations(
    cohort: DataFrame, events: DataFrame, labels: DataFrame, ecg: DataFrame | None = None, ecg_window: str = "w6"
) -> DataFrame:
    """All violated assertions. INFO rows describe, they do not fail a run. Without ECG features their check is left out."""
    bounds = cohort.select("stay_id", "ed_intime", "ed_outtime")
    e = events.join(bounds, "stay_id", "left")
    event_checks = {
        "events_before_ed": ("ERROR", F.col("event_time") < F.col("ed_intime"), F.col("event_type")),
        "icd_events_with_time": (
            "ERROR", F.col("event_type").isin(*R.UNTIMED_EVENTS) & F.col("event_time").isNotNull(), F.col("event_type")),
        "death_wrong_source": (
            "ERROR", (F.col("event_type") == "DEATH") & (F.col("source_table") != "hosp.admissions.deathtime"),
            F.col("source_table")),
    }
    label_checks = {}
    for n in EVENT_NAMES:
        w1, w6, w24 = (F.col(event_by_name(n, p)) for p in (1, 6, 24))
        label_checks[f"event_by_monotonicity_{n}"] = ("ERROR", (w1 > w6) | (w6 > w24), F.lit(n))
    label_checks["label_event_by_overlap_icu_w6"] = (
        "INFO",
        (F.col("icu_24h_from_w6") == 1) & (F.col("event_by_icu_w6") == 1) & (F.col("time_to_icu") <= 6),
        F.lit("icu"),
    )
    cohort_checks = {
        "age_out_of_bounds": ("ERROR", ~F.col("age_at_ed").between(18, 110), F.col("age_at_ed")),
        "dead_before_ed": ("ERROR", F.col("ed_intime") > F.col("dod").cast("timestamp_ntz"), F.col("dod")),
    }
    found = [_failed(e, event_checks), _failed(labels, label_checks), _failed(cohort, cohort_checks)]
    if ecg is not None:
        found.append(ecg_violations(cohort, ecg, ecg_window))
    return reduce(DataFrame.unionByName, found)


def ecg_violations(cohort: DataFrame, ecg: DataFrame, ecg_window: str) -> DataFrame:
    """ECGs that lie outside their stay."""
    t = f"ecg_time_{ecg_window}"
    g = ecg.select("stay_id", t).where(F.col(t).isNotNull()).join(cohort.select("stay_id", "ed_intime", "ed_outtime"), "stay_id")
    return _failed(g, {"ecg_outside_ed_window": ("ERROR", ~F.col(t).between(F.col("ed_intime"), F.col("ed_outtime")), F.col(t))})


def qa_summary(violations: DataFrame) -> DataFrame:
    """(check_name, severity, n); a run passes when no ERROR row is left."""
    return violations.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


def sanity_counts(cohort: DataFrame, events: DataFrame, labels: DataFrame) -> DataFrame:
    """Sizes and key prevalences; three one-row aggregates side by side."""
    one = F.lit(1).alias("_one")
    c = cohort.agg(F.count(F.lit(1)).alias("n_ed_visits"), F.count_distinct("subject_id").alias("n_unique_patients"))
    e = events.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("event_type").alias("n_event_types"))
    cols = ("deterioration_24h_from_w6", "icu_24h_from_w6", "death_24h_from_w6", "death_hosp")
    l = labels.agg(*[F.avg(x).alias(f"prev_{x}") for x in cols])
    return c.select("*", one).join(e.select("*", one), "_one").join(l.select("*", one), "_one").drop("_one")


def temporal_check(events: DataFrame, cohort: DataFrame) -> DataFrame:
    h = hours_between("ed_intime", "event_time")
    return (
        events.where(F.col("event_time").isNotNull()).join(cohort.select("stay_id", "ed_intime"), "stay_id")
        .agg(F.count_if(h < 0).alias("events_before_ed"), F.count_if(h < -1).alias("events_early_warning"),
             F.count(F.lit(1)).alias("total_events"))
    )


def outcome_consistency(labels: DataFrame) -> DataFrame:
    """Rows whose shorter horizon or earlier flag is set without the longer or later one."""
    def broken(a: str, b: str) -> Column:
        return F.count_if((F.col(a) == 1) & (F.col(b) == 0))

    return labels.agg(
        broken("icu_24h_from_w6", "icu_48h_from_w6").alias("icu_24h_not_48h_w6"),
        broken("death_24h_from_w6", "death_48h_from_w6").alias("death_24h_not_48h_w6"),
        broken("event_by_icu_w1", "event_by_icu_w6").alias("event_by_icu_w1_not_w6"),
        broken("event_by_icu_w6", "event_by_icu_w24").alias("event_by_icu_w6_not_w24"),
        F.count(F.lit(1)).alias("total_visits"),
    )


def join_integrity(cohort: DataFrame, labels: DataFrame) -> DataFrame:
    """Row counts of both sides and of their join, from one grouped pass over the keys."""
    sides = cohort.select("stay_id", F.lit(1).alias("b"), F.lit(0).alias("o")).unionByName(
        labels.select("stay_id", F.lit(0).alias("b"), F.lit(1).alias("o"))
    )
    per_key = sides.groupBy("stay_id").agg(F.sum("b").alias("b"), F.sum("o").alias("o"))
    return per_key.agg(
        F.sum("b").alias("base_count"), F.sum("o").alias("outcome_count"), F.sum(F.col("b") * F.col("o")).alias("joined_count")
    )


def completeness(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    return features.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"pct_{c}") for c in columns])


def consistency_checks(cohort, events, labels, first_hour) -> DataFrame:
    """(check_name, n) for the whole stage build; every n should be 0 except the row counts."""
    one = F.lit(1).alias("_one")
    parts = [temporal_check(events, cohort), outcome_consistency(labels), join_integrity(cohort, labels)]
    parts.append(first_hour.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("temp_w1", "hr_w1", "sbp_w1", "spo2_w1")]))
    wide = reduce(lambda a, b: a.join(b, "_one"), [p.select("*", one) for p in parts]).drop("_one")
    return long_form(wide, {c: {"n": F.col(c).cast("long")} for c in wide.columns}, "check_name")


def dataset_checks(df: DataFrame, label: str = "y") -> DataFrame:
    """(column_name, all_null, constant) for columns that are one or the other; ids and label exempt from "constant".

    Both follow from minimum, maximum and count, which need no distinct count.
    """
    if not df.columns:
        raise ValueError("a dataset needs columns")
    exempt = ("stay_id", "subject_id", "hadm_id", label)
    aggs = []
    for c in df.columns:
        aggs += [F.count(c).alias(f"n_{c}"), (F.min(c) == F.max(c)).alias(f"same_{c}")]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = {
        c: {
            "all_null": (F.col("_n") > 0) & (F.col(f"n_{c}") == 0),
            "constant": F.lit(c not in exempt) & F.coalesce(F.col(f"same_{c}"), F.lit(False)),
        }
        for c in df.columns
    }
    return long_form(wide, rows, "column_name").where("all_null OR constant")


def dataset_metrics(df: DataFrame, label: str = "y") -> DataFrame:
    """n_rows, n_features and outcome rate (NULL without a label) in one row."""
    rate = F.avg(label) if label in df.columns else F.lit(None).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns) - 1).alias("n_features"), rate.alias("outcome_rate")
    )


def event_by_statistics(labels: DataFrame) -> DataFrame:
    """Per event: counts and prevalence by window, monotonicity violations."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for n in EVENT_NAMES:
        w1, w6, w24 = (event_by_name(n, p) for p in (1, 6, 24))
        aggs += [F.sum(c).cast("long").alias(c) for c in (w1, w6, w24)]
        aggs += [F.count_if(F.col(w1) > F.col(w6)).alias(f"_{n}_a"), F.count_if(F.col(w6) > F.col(w24)).alias(f"_{n}_b")]
    wide = labels.agg(*aggs)
    rows = {}
    for n in EVENT_NAMES:
        counts = {f"n_w{p}": F.col(event_by_name(n, p)) for p in (1, 6, 24)}
        rates = {f"pct_w{p}": 100.0 * F.col(event_by_name(n, p)) / F.col("_n") for p in (1, 6, 24)}
        rows[n] = {**counts, **rates, "w1_above_w6": F.col(f"_{n}_a"), "w6_above_w24": F.col(f"_{n}_b")}
    return long_form(wide, rows, "event")


def label_flag_overlap(labels: DataFrame) -> DataFrame:
    """Already-happened flags against aligned labels at 6 h."""
    wide = {}
    for n in ("icu", "deterioration"):
        by, after = F.col(f"event_by_{n}_w6") == 1, F.col(f"{n}_24h_from_w6") == 1
        wide |= {f"{n}_by_w6": F.count_if(by), f"{n}_after_w6": F.count_if(after), f"{n}_both": F.count_if(by & after)}
    return labels.agg(*[c.alias(n) for n, c in wide.items()])


def adhoc_checks(cohort: DataFrame, labels: DataFrame, features: DataFrame, ecg: DataFrame, ecg_window: str = "w6") -> DataFrame:
    """Duplicate keys, cohort/label row difference, vitals and ECG coverage."""
    one = F.lit(1).alias("_one")
    c = cohort.agg(
        F.count(F.lit(1)).alias("n_cohort"), (F.count(F.lit(1)) - F.count_distinct("stay_id")).alias("duplicate_stays")
    )
    l = labels.agg(F.count(F.lit(1)).alias("n_labels"))
    f = features.agg(F.avg(F.col("hr_mean_6h").isNotNull().cast("double")).alias("vitals_coverage"))
    g = ecg.agg(F.avg((F.col(f"missing_ecg_{ecg_window}") == 0).cast("double")).alias("ecg_coverage"))
    return reduce(lambda a, b: a.join(b, "_one"), [x.select("*", one) for x in (c, l, f, g)]).drop("_one")


def null_rates(df: DataFrame) -> DataFrame:
    """(column_name, null_rate) of the numeric columns."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "float", "double") or t.startswith("decimal")]
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in numeric])
    return long_form(wide, {c: {"null_rate": F.col(c)} for c in numeric}, "column_name")


def vital_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, min, mean, max) for the given columns."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    rows = {c: {s: F.col(f"{c}_{s}").cast("double") for s in ("min", "mean", "max")} for c in columns}
    return long_form(df.agg(*aggs), {c: {f"{s}_value": x for s, x in r.items()} for c, r in rows.items()}, "column_name")
