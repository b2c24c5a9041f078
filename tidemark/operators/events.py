"""Event extractors and the eight-column event log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.matching import CodeRule, any_keyword, code_event_types
from tidemark.functions.timeops import hours_between, interval_join

LOG_COLUMNS = (
    "subject_id", "stay_id", "hadm_id", "event_type",
    "event_time", "event_time_type", "source_table", "event_detail",
)


def _anchors(cohort: DataFrame) -> DataFrame:
    """Admitted anchors with the closed extraction interval [t_in, t_out + 7 days]."""
    return cohort.where(F.col("hadm_id").isNotNull()).select(
        "subject_id", "stay_id", "hadm_id", "ed_intime",
        (F.col("ed_outtime") + F.expr("INTERVAL 7 DAYS")).alias("_until"),
    )


def _log(df: DataFrame, event_type: Column, time: Column, time_type: str, source: str, detail: Column) -> DataFrame:
    return df.select(
        "subject_id", "stay_id", "hadm_id",
        event_type.alias("event_type"),
        time.cast("timestamp_ntz").alias("event_time"),
        F.lit(time_type).alias("event_time_type"),
        F.lit(source).alias("source_table"),
        detail.alias("event_detail"),
    )


def distinct_text(c: str | Column, sep: str = "; ") -> Column:
    """Distinct values in sorted order as one string.

    The set is bounded by the dictionary the labels come from, and it is built
    by partial aggregation, so one shuffle suffices.
    """
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def icu_admissions(cohort: DataFrame, unit_stays: DataFrame) -> DataFrame:
    """One row per unit stay that starts inside the extraction interval."""
    hits = interval_join(
        _anchors(cohort), unit_stays.select("hadm_id", "intime", "first_careunit"),
        ["hadm_id"], "intime", "ed_intime", "_until",
    )
    return _log(hits, F.lit("ICU_ADMIT"), F.col("intime"), "exact", "icu.icustays", F.col("first_careunit"))


def keyword_items(dictionary: DataFrame, words: Sequence[str]) -> DataFrame:
    """Dictionary rows whose label contains one of the words."""
    return (
        dictionary.where(F.col("itemid").isNotNull() & any_keyword(F.col("label"), words))
        .select("itemid", "label")
        .distinct()
    )


def typed_items(dictionary: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """(itemid, label, event_type): dictionary rows once per event type whose keywords they match."""
    hits = F.array_compact(F.array(*[F.when(any_keyword(F.col("label"), w), F.lit(t)) for t, w in words.items()]))
    return (
        dictionary.where(F.col("itemid").isNotNull())
        .select("itemid", "label", F.explode(hits).alias("event_type"))
        .distinct()
    )


def item_hits(facts: DataFrame, items: DataFrame, time: str, source: str) -> DataFrame:
    """(hadm_id, event_type, source_table, event_time, label) of facts with a typed item.

    All event types of a fact table are found in one pass over it. Whether the
    filtered dictionary is broadcast is left to the optimizer, which knows its
    size.
    """
    return (
        facts.where(F.col(time).isNotNull() & F.col("hadm_id").isNotNull())
        .select("hadm_id", "itemid", F.col(time).alias("event_time"))
        .join(items, "itemid")
        .select("hadm_id", "event_type", F.lit(source).alias("source_table"), "event_time", "label")
    )


def first_per_stay(cohort: DataFrame, hits: DataFrame) -> DataFrame:
    """Earliest hit per stay and event type, with all distinct labels of the interval.

    Minimum and distinct labels do not change when a hit appears twice, so hits
    from several sources need no deduplication first.
    """
    found = (
        interval_join(_anchors(cohort), hits, ["hadm_id"], "event_time", "ed_intime", "_until")
        .groupBy("subject_id", "stay_id", "hadm_id", "event_type", "source_table")
        .agg(F.min("event_time").alias("event_time"), distinct_text("label").alias("event_detail"))
    )
    return found.withColumn("event_time_type", F.lit("exact")).select(*LOG_COLUMNS)


_PROCEDURE_WORDS = {"VENT_START": R.VENT_PROCEDURE_WORDS, "RRT_START": R.RRT_PROCEDURE_WORDS}
_CHART_WORDS = {"VENT_START": R.VENT_CHART_WORDS, "RRT_START": R.RRT_CHART_WORDS}


def pressor_hits(inputs: DataFrame, items: DataFrame) -> DataFrame:
    """Administered vasopressors."""
    typed = typed_items(items, {"PRESSOR_START": R.PRESSOR_WORDS})
    return item_hits(inputs.where(F.col("amount") > 0), typed, "starttime", "icu.inputevents")


def support_hits(procedures: DataFrame, charts: DataFrame, items: DataFrame) -> DataFrame:
    """Ventilation and renal replacement from procedures and charted settings; each table is read once."""
    source = "icu.procedureevents+chartevents"
    done = item_hits(procedures, typed_items(items, _PROCEDURE_WORDS), "starttime", source)
    charted = item_hits(charts.where(F.col("value").isNotNull()), typed_items(items, _CHART_WORDS), "charttime", source)
    return done.unionByName(charted)


def pressor_starts(cohort, inputs, items) -> DataFrame:
    return first_per_stay(cohort, pressor_hits(inputs, items))


def ventilation_starts(cohort, procedures, charts, items) -> DataFrame:
    return first_per_stay(cohort, support_hits(procedures, charts, items).where("event_type = 'VENT_START'"))


def rrt_starts(cohort, procedures, charts, items) -> DataFrame:
    return first_per_stay(cohort, support_hits(procedures, charts, items).where("event_type = 'RRT_START'"))


def matching_codes(dictionary: DataFrame, rules: Sequence[CodeRule], normalize: bool = False) -> DataFrame:
    """Dictionary rows with the event type(s) their code stands for."""
    types = code_event_types(rules, F.col("icd_code"), F.col("icd_version"), normalize)
    return dictionary.select("icd_code", "icd_version", "long_title", F.explode(types).alias("event_type"))


def code_hits(
    coded: DataFrame, dictionary: DataFrame, rules: Sequence[CodeRule], source: str, normalize: bool = False
) -> DataFrame:
    """(hadm_id, event_type, source_table, long_title) of coded rows; all event types in one pass."""
    codes = matching_codes(dictionary, rules, normalize)
    if normalize:
        codes = codes.withColumn("icd_code", F.regexp_replace("icd_code", r"\.", ""))
        coded = coded.withColumn("icd_code", F.regexp_replace("icd_code", r"\.", ""))
    return (
        coded.where(F.col("hadm_id").isNotNull()).select("hadm_id", "icd_code", "icd_version")
        .join(codes, ["icd_code", "icd_version"])
        .select("hadm_id", "event_type", F.lit(source).alias("source_table"), "long_title")
    )


def untimed_per_stay(cohort: DataFrame, hits: DataFrame) -> DataFrame:
    """Untimed events of the index admission, one row per stay and event type."""
    found = (
        cohort.where(F.col("hadm_id").isNotNull())
        .select("subject_id", "stay_id", "hadm_id")
        .join(hits, "hadm_id")
        .groupBy("subject_id", "stay_id", "hadm_id", "event_type", "source_table")
        .agg(distinct_text("long_title").alias("event_detail"))
    )
    return found.select(
        "*", F.lit(None).cast("timestamp_ntz").alias("event_time"), F.lit("none").alias("event_time_type")
    ).select(*LOG_COLUMNS)


def code_events(
    cohort: DataFrame, coded: DataFrame, dictionary: DataFrame, rules: Sequence[CodeRule],
    source: str, normalize: bool = False,
) -> DataFrame:
    return untimed_per_stay(cohort, code_hits(coded, dictionary, rules, source, normalize))


def deaths(cohort: DataFrame, admissions: DataFrame) -> DataFrame:
    """In-hospital deaths at or after arrival, without upper bound."""
    hits = (
        cohort.where(F.col("hadm_id").isNotNull())
        .select("subject_id", "stay_id", "hadm_id", "ed_intime")
        .join(admissions.where(F.col("deathtime").isNotNull()).select("hadm_id", "deathtime"), "hadm_id")
        .where(F.col("deathtime") >= F.col("ed_intime"))
    )
    return _log(
        hits, F.lit("DEATH"), F.col("deathtime"), "exact", "hosp.admissions.deathtime", F.lit("In-hospital death")
    )


def build_event_log(cohort: DataFrame, src, normalize_codes: bool = False) -> DataFrame:
    """Union of all extractors. An extractor that fails fails the build.

    Hits of the same kind are stacked before they meet the cohort: one interval
    join finds the first start of every support event, one join all coded events.
    """
    starts = pressor_hits(src.inputs, src.items).unionByName(
        support_hits(src.procedure_events, src.chart_events, src.items)
    )
    coded = code_hits(
        src.diagnoses, src.diagnosis_codes, R.DIAGNOSIS_RULES, "hosp.diagnoses_icd (hospitalization-level)", normalize_codes
    ).unionByName(code_hits(
        src.procedures, src.procedure_codes, R.PROCEDURE_RULES, "hosp.procedures_icd (hospitalization-level)", normalize_codes
    ))
    parts = [
        icu_admissions(cohort, src.unit_stays),
        first_per_stay(cohort, starts),
        untimed_per_stay(cohort, coded),
        deaths(cohort, src.admissions),
    ]
    return reduce(DataFrame.unionByName, parts)


def event_counts(events: DataFrame) -> DataFrame:
    """Rows and share of the total per event type."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    return (
        counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
        .select("event_type", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))
    )


def code_match_counts(coded: DataFrame, dictionary: DataFrame, rules: Sequence[CodeRule], normalize=False) -> DataFrame:
    """Diagnostic: coded rows and distinct admissions per event type."""
    return (
        coded.join(matching_codes(dictionary, rules, normalize), ["icd_code", "icd_version"])
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hadm_id").alias("n_admissions"))
    )


def event_type_patterns(events: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Diagnostic: NULL types, and rows whose type matches each LIKE pattern."""
    wide = events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type").isNull()).alias("null_types"),
        *[F.count_if(F.col("event_type").like(p)).alias(p) for p in patterns],
    )
    names = ["total", "null_types", *patterns]
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")
    ).select("x.pattern", "x.n")


def event_timing_profile(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Timed events relative to arrival: counts around arrival and hour statistics."""
    timed = events.where(F.col("event_time").isNotNull()).join(
        cohort.select("stay_id", "ed_intime"), "stay_id"
    ).select("stay_id", hours_between("ed_intime", "event_time").alias("h"))
    return timed.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("stay_id").alias("visits_with_events"),
        F.count_if(F.col("h") < 0).alias("events_before_ed"),
        F.count_if(F.col("h") < -1).alias("events_early_warning"),
        F.count_if(F.col("h") <= 24).alias("events_within_24h"),
        F.count_if(F.col("h") <= 48).alias("events_within_48h"),
        F.avg("h").alias("mean_hours_from_ed"),
        F.min("h").alias("min_hours_from_ed"),
        F.max("h").alias("max_hours_from_ed"),
    )
