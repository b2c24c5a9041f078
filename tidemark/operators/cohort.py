"""Anchor cohort: one row per stay, with explicit inclusion rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeops import hours_between

PRESETS = {
    "all": None,
    "admitted": lambda: F.col("hadm_id").isNotNull(),
    "not_admitted": lambda: F.col("hadm_id").isNull(),
}


def build_cohort(stays: DataFrame, persons: DataFrame, min_age: int = 18, max_age: int = 110) -> DataFrame:
    """Stays with a known, positive duration of persons of eligible age, alive on arrival.

    ``dod`` is a date, so a person who died on the day of arrival is excluded
    unless arrival was at midnight.
    """
    joined = (
        stays.where(F.col("intime").isNotNull() & F.col("outtime").isNotNull() & (F.col("outtime") > F.col("intime")))
        .join(persons, "subject_id")
        .withColumn("age_at_ed", F.col("anchor_age") + F.year("intime") - F.col("anchor_year"))
    )
    alive = F.col("dod").isNull() | (F.col("intime") <= F.col("dod").cast("timestamp_ntz"))
    return joined.where(F.col("age_at_ed").between(min_age, max_age) & alive).select(
        "subject_id",
        "stay_id",
        "hadm_id",
        F.col("intime").alias("ed_intime"),
        F.col("outtime").alias("ed_outtime"),
        "anchor_age",
        "anchor_year",
        "gender",
        "dod",
        "age_at_ed",
        "arrival_transport",
        "disposition",
        "race",
        hours_between("intime", "outtime").alias("ed_los_hours"),
        F.col("hadm_id").isNotNull().cast("int").alias("was_admitted"),
    )


_QUOTED = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""", re.DOTALL)
_REJECTED = re.compile(r"\b(select|exists|count|sum|avg|min|max|over)\b", re.IGNORECASE)


def custom_filter(text: str) -> Column | None:
    """User predicate as a Column; a leading WHERE is allowed, subqueries and aggregates are not.

    Only what stands outside quotes is looked at, so literals stay as written.
    """
    text = re.sub(r"^\s*where\b", "", text, flags=re.IGNORECASE).strip()
    if not text:
        return None
    parts = _QUOTED.split(text)  # every second part is quoted
    parts[::2] = [re.sub(r"\b[bfo]\.(?=[A-Za-z_`])", "", p) for p in parts[::2]]  # table prefixes of hand-written filters
    text = "".join(parts)
    if any(_REJECTED.search(p) for p in parts[::2]):
        raise ValueError("a cohort filter may not contain subqueries, aggregates or window functions")
    return F.expr(f"({text})")


def select_cohort(df: DataFrame, preset: str = "all", where: str = "") -> DataFrame:
    """Apply a named preset and an optional custom predicate."""
    if preset not in PRESETS:
        raise ValueError(f"unknown cohort preset {preset!r}, expected one of {sorted(PRESETS)}")
    if PRESETS[preset] is not None:
        df = df.where(PRESETS[preset]())
    extra = custom_filter(where)
    return df if extra is None else df.where(extra)


def cohort_profile(cohort: DataFrame) -> DataFrame:
    """Twelve summary figures of a cohort in one row."""
    return cohort.agg(
        F.count(F.lit(1)).alias("total_visits"),
        F.count_distinct("subject_id").alias("unique_patients"),
        F.count_distinct("hadm_id").alias("unique_admissions"),
        F.avg("age_at_ed").alias("mean_age"),
        F.min("age_at_ed").alias("min_age"),
        F.max("age_at_ed").alias("max_age"),
        F.avg(F.when(F.col("gender") == "M", 1.0).otherwise(0.0)).alias("pct_male"),
        F.avg("ed_los_hours").alias("mean_ed_los_hours"),
        F.min("ed_los_hours").alias("min_ed_los_hours"),
        F.max("ed_los_hours").alias("max_ed_los_hours"),
        F.count_if(F.col("ed_los_hours") < 1).alias("n_short_stays"),
        F.count_if(F.col("ed_los_hours") > 48).alias("n_long_stays"),
    )
