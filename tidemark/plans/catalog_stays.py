"""Queries on the stays binding: cohort, events, labels, features, datasets, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.reshape import long_form
from tidemark.operators import cohort as C
from tidemark.operators import dataset as D
from tidemark.operators import ecg as G
from tidemark.operators import events as E
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import profile as P
from tidemark.operators import qa as Q
from tidemark.plans import bindings as B
from tidemark.plans.oracle import TIME_COLS, W1_DOUBLES, doubles_of, ecg_doubles, hours, q, r6
from tidemark.plans.registry import query, rounded

# --- cohort --------------------------------------------------------------------------


@query("cohort_filter", q(r6("SELECT * FROM cohort", "ed_los_hours")))
def cohort_filter(t):
    return rounded(t.cohort)


@query("cohort_profile", q(r6("""
SELECT count(*) AS total_visits, count(DISTINCT subject_id) AS unique_patients, count(DISTINCT hadm_id) AS unique_admissions,
       avg(age_at_ed) AS mean_age, min(age_at_ed) AS min_age, max(age_at_ed) AS max_age,
       sum(CASE WHEN gender = 'M' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS pct_male, avg(ed_los_hours) AS mean_ed_los_hours,
       min(ed_los_hours) AS min_ed_los_hours, max(ed_los_hours) AS max_ed_los_hours,
       count(*) FILTER (WHERE ed_los_hours < 1) AS n_short_stays, count(*) FILTER (WHERE ed_los_hours > 48) AS n_long_stays
FROM cohort""", "mean_age pct_male mean_ed_los_hours min_ed_los_hours max_ed_los_hours")))
def cohort_profile(t):
    return rounded(C.cohort_profile(t.cohort))


@query("cohort_presets", q("""
SELECT 'all' AS preset, count(*) AS n FROM cohort
UNION ALL SELECT 'admitted', count(*) FROM cohort WHERE hadm_id IS NOT NULL
UNION ALL SELECT 'not_admitted', count(*) FROM cohort WHERE hadm_id IS NULL"""))
def cohort_presets(t):
    wide = t.cohort.agg(*[
        (F.count_if(p()) if p else F.count(F.lit(1))).alias(n) for n, p in C.PRESETS.items()
    ])
    return long_form(wide, {n: {"n": F.col(n)} for n in C.PRESETS}, "preset")


_CUSTOM = "stay_id subject_id age_at_ed gender sbp_mean_24h hr_mean_24h troponin_first_24h death_24h_from_w24 icu_24h_from_w24"


@query("custom_cohort", q(r6("""
SELECT b.stay_id, b.subject_id, b.age_at_ed, b.gender, f.sbp_mean_24h, f.hr_mean_24h, f.troponin_first_24h,
       o.death_24h_from_w24, o.icu_24h_from_w24
FROM cohort b JOIN features_w24 f USING (stay_id) JOIN labels o USING (stay_id)
WHERE b.hadm_id IS NOT NULL AND b.age_at_ed >= 40 AND f.troponin_first_24h > 0.04""",
    "sbp_mean_24h hr_mean_24h troponin_first_24h")))
def custom_cohort(t):
    wide = (
        t.staged.join(t.features(R.W24).drop("age_at_ed", "gender", "arrival_transport", "race", "ed_los_hours"), "stay_id")
        .join(t.labels.drop("subject_id", "hadm_id", "ed_intime", "ed_outtime"), "stay_id")
    )
    picked = C.select_cohort(wide, "admitted", "WHERE b.age_at_ed >= 40 AND f.troponin_first_24h > 0.04")
    return rounded(picked.select(*_CUSTOM.split()))


# --- events --------------------------------------------------------------------------


@query("event_log", q("SELECT * FROM evlog"))
def event_log(t):
    return t.events


@query("first_event_distinct_labels", q("SELECT stay_id, event_time, event_detail FROM evlog WHERE event_type = 'PRESSOR_START'"))
def first_event_distinct_labels(t):
    return E.pressor_starts(t.staged, t.src.inputs, t.src.items).select("stay_id", "event_time", "event_detail")


@query("code_set_events", q("SELECT stay_id, hadm_id, event_type, event_detail FROM evlog WHERE event_type IN ('PCI', 'CABG')"))
def code_set_events(t):
    found = E.code_events(t.staged, t.src.procedures, t.src.procedure_codes, R.PROCEDURE_RULES, "procedures")
    return found.select("stay_id", "hadm_id", "event_type", "event_detail")


@query("event_counts", q(r6(
    "SELECT event_type, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM evlog) AS pct FROM evlog GROUP BY 1", "pct")))
def event_counts(t):
    return rounded(E.event_counts(t.events))


@query("code_match_counts", q("SELECT event_type, count(*) AS n_rows, count(DISTINCT hadm_id) AS n_admissions FROM dx_hits GROUP BY 1"))
def code_match_counts(t):
    return E.code_match_counts(t.src.diagnoses, t.src.diagnosis_codes, R.DIAGNOSIS_RULES)


@query("event_type_patterns", q("""
SELECT 'total' AS pattern, count(*) AS n FROM evlog
UNION ALL SELECT 'null_types', count(*) FROM evlog WHERE event_type IS NULL
UNION ALL SELECT '%START%', count(*) FROM evlog WHERE event_type LIKE '%START%'
UNION ALL SELECT 'C%', count(*) FROM evlog WHERE event_type LIKE 'C%'"""))
def event_type_patterns(t):
    return E.event_type_patterns(t.events, ["%START%", "C%"])


_H = hours("b.ed_intime", "e.event_time")


@query("event_timing_profile", q(r6(f"""
SELECT count(*) AS total_events, count(DISTINCT stay_id) AS visits_with_events, count(*) FILTER (WHERE h < 0) AS events_before_ed,
       count(*) FILTER (WHERE h < -1) AS events_early_warning, count(*) FILTER (WHERE h <= 24) AS events_within_24h,
       count(*) FILTER (WHERE h <= 48) AS events_within_48h, avg(h) AS mean_hours_from_ed, min(h) AS min_hours_from_ed,
       max(h) AS max_hours_from_ed
FROM (SELECT stay_id, {_H} AS h FROM evlog e JOIN cohort b USING (stay_id) WHERE e.event_time IS NOT NULL)""",
    "mean_hours_from_ed min_hours_from_ed max_hours_from_ed")))
def event_timing_profile(t):
    return rounded(E.event_timing_profile(t.events, t.staged))


# --- labels --------------------------------------------------------------------------


@query("label_grid", q(r6("SELECT * FROM labels", TIME_COLS)))
def label_grid(t):
    return rounded(t.labels)


_BY = [L.event_by_name(n, p) for n in Q.EVENT_NAMES for p in R.PREDICTION_HOURS]


@query("event_by_flags", q(f"SELECT stay_id, {', '.join(_BY)} FROM labels"))
def event_by_flags(t):
    return t.labels.select("stay_id", *_BY)


@query("time_to_event", q(r6(f"SELECT stay_id, {', '.join(TIME_COLS)} FROM labels", TIME_COLS)))
def time_to_event(t):
    return rounded(t.labels.select("stay_id", *TIME_COLS))


_COMPOSITES = [f"deterioration_{h}h_from_w{p}" for h in (24, 48) for p in R.PREDICTION_HOURS]


@query("composite_labels", q(f"""
SELECT stay_id, {', '.join(_COMPOSITES)}, CASE WHEN death_hosp = 1 OR cardiac_arrest_hosp = 1 OR pressor_24h_from_w6 = 1
  THEN 1 ELSE 0 END AS critical_any FROM labels"""))
def composite_labels(t):
    own = L.composite(["death_hosp", "cardiac_arrest_hosp", "pressor_24h_from_w6"]).alias("critical_any")
    return t.labels.select("stay_id", *_COMPOSITES, own)


@query("untimed_flags", q("SELECT * FROM untimed_agg"))
def untimed_flags(t):
    return L.untimed_flags(t.events)


_REVISIT = """EXISTS (SELECT 1 FROM cohort b2 WHERE b2.subject_id = b.subject_id AND b2.stay_id <> b.stay_id
  AND b2.ed_intime > b.ed_outtime AND b2.ed_intime <= b.ed_outtime + INTERVAL 3 DAY)"""


@query("revisit_exists", q(f"SELECT b.stay_id, CASE WHEN {_REVISIT} THEN 1 ELSE 0 END AS outcome_ed_revisit_3d FROM cohort b"))
def revisit_exists(t):
    return L.revisits(t.staged)


@query("benchmark_labels", q(r6(f"""
SELECT b.subject_id, b.hadm_id, b.stay_id, b.ed_intime AS intime, b.ed_outtime AS outtime, b.age_at_ed AS age, b.gender, b.race,
       b.arrival_transport, b.ed_los_hours, b.was_admitted AS outcome_hospitalization,
       CASE WHEN i.h <= 12 THEN 1 ELSE 0 END AS outcome_icu_transfer_12h, CASE WHEN d.h IS NOT NULL THEN 1 ELSE 0 END AS outcome_critical,
       CASE WHEN {_REVISIT} THEN 1 ELSE 0 END AS outcome_ed_revisit_3d,
       CASE WHEN EXISTS (SELECT 1 FROM evlog e WHERE e.stay_id = b.stay_id AND e.event_type = 'DEATH') THEN 1 ELSE 0 END AS outcome_inhospital_mortality,
       f.temp_w1 AS triage_temperature, f.hr_w1 AS triage_heartrate, f.rr_w1 AS triage_resprate, f.spo2_w1 AS triage_o2sat,
       f.sbp_w1 AS triage_sbp, f.dbp_w1 AS triage_dbp, f.triage_pain, f.triage_acuity,
       i.h AS time_to_icu_hours, d.h AS time_to_deterioration_hours
FROM cohort b JOIN features_w1 f ON f.stay_id = b.stay_id
LEFT JOIN (SELECT e.stay_id, min({_H}) AS h FROM evlog e JOIN cohort b USING (stay_id) WHERE e.event_type = 'ICU_ADMIT'
  AND e.event_time >= b.ed_intime GROUP BY 1) i ON i.stay_id = b.stay_id
LEFT JOIN (SELECT e.stay_id, min({_H}) AS h FROM evlog e JOIN cohort b USING (stay_id)
  WHERE e.event_type IN ('ICU_ADMIT', 'PRESSOR_START', 'VENT_START', 'RRT_START', 'DEATH')
  AND e.event_time >= b.ed_intime AND {_H} <= 24 GROUP BY 1) d ON d.stay_id = b.stay_id""",
    "ed_los_hours triage_temperature triage_heartrate triage_resprate triage_o2sat triage_sbp triage_dbp time_to_icu_hours time_to_deterioration_hours")))
def benchmark_labels(t):
    return rounded(L.benchmark_labels(t.staged, t.events, t.features(R.W1)))


# --- features ------------------------------------------------------------------------


@query("features_w1", q(r6("SELECT * FROM features_w1", W1_DOUBLES)))
def features_w1(t):
    return rounded(t.features(R.W1))


@query("features_w6", q(r6("SELECT * FROM features_w6", doubles_of(R.W6))))
def features_w6(t):
    return rounded(t.features(R.W6))


@query("features_w24", q(r6("SELECT * FROM features_w24", doubles_of(R.W24))))
def features_w24(t):
    return rounded(t.features(R.W24))


def _truncated(t, spec, parity=False):
    ends = X.truncated_ends(t.staged, t.labels, [spec], clamp=not parity)
    return rounded(t.features(spec, ends=ends, rank_by_admission=parity))


@query("features_w6_truncated", q(r6("SELECT * FROM features_w6t", doubles_of(R.W6))))
def features_w6_truncated(t):
    return _truncated(t, R.W6)


@query("features_w24_truncated", q(r6("SELECT * FROM features_w24t", doubles_of(R.W24))))
def features_w24_truncated(t):
    return _truncated(t, R.W24)


@query("features_w24_truncated_by_admission", q(r6("SELECT * FROM features_w24p", doubles_of(R.W24))))
def features_w24_truncated_by_admission(t):
    return _truncated(t, R.W24, parity=True)


_CLASH = ("arrival_transport", "race", "chiefcomplaint", "time_to_first_lab_hours", "time_to_first_med_hours",
          "prev_admits_1yr", "prev_ed_visits_1yr")
_BOTH = """
SELECT f.* RENAME ({r6}), g.* EXCLUDE (stay_id, age_at_ed, gender, ed_los_hours) RENAME ({r24})
FROM features_w6 f JOIN features_w24 g ON f.stay_id = g.stay_id""".format(
    r6=", ".join(f"{c} AS {c}_w6" for c in _CLASH), r24=", ".join(f"{c} AS {c}_w24" for c in _CLASH))
_BOTH_DOUBLES = list(dict.fromkeys(
    [f"{c}_w6" if c in _CLASH else c for c in doubles_of(R.W6)] + [f"{c}_w24" if c in _CLASH else c for c in doubles_of(R.W24)]))


@query("features_multi_window", q(r6(_BOTH, _BOTH_DOUBLES)))
def features_multi_window(t):
    return rounded(t.features(R.W6, R.W24))


_MIXED = """
SELECT b.stay_id, b.age_at_ed, b.gender, b.ed_los_hours, f.* EXCLUDE (stay_id_w6), t.* EXCLUDE (stay_id_w6t),
       g.* EXCLUDE (stay_id, age_at_ed, gender, ed_los_hours) RENAME ({r24})
FROM features_w24 b
JOIN (SELECT COLUMNS('(.*)') AS '\\1_w6' FROM (SELECT * EXCLUDE (age_at_ed, gender, ed_los_hours) FROM features_w6)) f ON f.stay_id_w6 = b.stay_id
JOIN (SELECT COLUMNS('(.*)') AS '\\1_w6t' FROM (SELECT * EXCLUDE (age_at_ed, gender, ed_los_hours) FROM features_w6t)) t ON t.stay_id_w6t = b.stay_id
JOIN features_w24 g ON g.stay_id = b.stay_id""".format(r24=", ".join(f"{c} AS {c}_w24" for c in _CLASH))
_MIXED_DOUBLES = ["ed_los_hours", *[f"{c}_{w}" for c in doubles_of(R.W6) if c != "ed_los_hours" for w in ("w6", "w6t")],
                  *[f"{c}_w24" if c in _CLASH else c for c in doubles_of(R.W24) if c != "ed_los_hours"]]


@query("features_mixed_windows", q(r6(_MIXED, _MIXED_DOUBLES)))
def features_mixed_windows(t):
    specs = (R.W6, R.truncated_window(R.W6), R.W24)
    return rounded(t.features(*specs, ends=X.mixed_ends(t.staged, t.labels, specs)))


@query("vitals_summary", q(r6("SELECT * FROM vit_w24", [c for c in doubles_of(R.W24) if c.split("_")[0] in R.VITAL_COLUMNS])))
def vitals_summary(t):
    return rounded(X.vitals_summary(X.with_window_ends(t.staged, [R.W24]), t.src.vitals, [R.W24]))




#: values outside are left out of the last and first ones
_RANGES = (("hr", 20.0, 250.0), ("sbp", 15.0, 40.0), ("temp", 95.0, 103.0))


def _last_and_delta() -> str:
    limits = {short: (lo, hi) for short, lo, hi in _RANGES}
    out = []
    for short, column in R.VITAL_COLUMNS.items():
        lo, hi = limits.get(short, ("-infinity", "infinity"))
        point = f"(struct_pack(t := v.charttime, x := v.{column})) FILTER (v.{column} BETWEEN '{lo}'::DOUBLE AND '{hi}'::DOUBLE)"
        out.append(f"(max{point}).x AS {short}_last_24h, (max{point}).x - (min{point}).x AS delta_{short}_24h")
    return ", ".join(out)


@query("feature_options", q(r6(f"""
SELECT stay_id, {_last_and_delta()} FROM vitals v JOIN ends_w24 e USING (stay_id)
WHERE v.charttime BETWEEN e.ed_intime AND e.t_end GROUP BY stay_id""", [f"{p}{v}{s}" for v in R.VITAL_COLUMNS for p, s in (("", "_last_24h"), ("delta_", "_24h"))])))
def feature_options(t):
    every = tuple(R.VITAL_COLUMNS)
    spec = R.WindowSpec("opt", 24, "24h", last_vitals=every, delta_vitals=every, ranges=_RANGES)
    return rounded(X.vitals_summary(X.with_window_ends(t.staged, [spec]), t.src.vitals, [spec]))


@query("time_to_first", q(r6(f"""
SELECT e.stay_id, min({hours('e.ed_intime', 'v.charttime')}) AS time_to_first_vital_24h
FROM ends_w24 e JOIN vitals v ON v.stay_id = e.stay_id WHERE v.charttime BETWEEN e.ed_intime AND e.t_end GROUP BY 1""",
    "time_to_first_vital_24h")))
def time_to_first(t):
    spec = R.WindowSpec("ttf", 24, "24h", time_to_first_vital=True)
    return rounded(X.vitals_summary(X.with_window_ends(t.staged, [spec]), t.src.vitals, [spec]))


@query("prior_history", q("SELECT * FROM history"))
def prior_history(t):
    events = B.raw_events(t.spark, t.sf_dir)
    return X.prior_history(t.staged, B.admissions_from(events), B.stays_from(events))


@query("ratio_features", q(r6("""
SELECT stay_id, sbp_cv_6h, hr_range_6h, CASE WHEN sbp_mean_6h > 0 THEN hr_mean_6h / sbp_mean_6h END AS shock_index_6h
FROM features_w6""", "sbp_cv_6h hr_range_6h shock_index_6h")))
def ratio_features(t):
    return rounded(X.shock_index_from_means(t.features(R.W6)).select("stay_id", "sbp_cv_6h", "hr_range_6h", "shock_index_6h"))


@query("ecg_first_w1", q(r6("SELECT * FROM ecg_w1", ecg_doubles("w1"))))
def ecg_first_w1(t):
    return rounded(t.ecg(1, "w1"))


@query("ecg_first_w6", q(r6("SELECT * FROM ecg_w6", ecg_doubles("w6"))))
def ecg_first_w6(t):
    return rounded(t.ecg(6, "w6"))


# --- datasets ------------------------------------------------------------------------

_BASE = "b.stay_id, b.subject_id, b.hadm_id, b.ed_intime, b.ed_outtime, b.age_at_ed, b.gender, b.ed_los_hours"
_F6 = "f.* EXCLUDE (stay_id, age_at_ed, gender, ed_los_hours)"


@query("dataset_single", q(r6(f"""
SELECT {_BASE}, {_F6}, o.deterioration_24h_from_w6 AS y, o.event_by_deterioration_w6
FROM cohort b JOIN features_w6 f USING (stay_id) JOIN labels o USING (stay_id)""", doubles_of(R.W6))))
def dataset_single(t):
    spec = D.DatasetSpec("d", ("W6",), ("deterioration_24h_from_w6",), missing_threshold=None)
    return rounded(D.assemble(t.staged, t.features(R.W6), t.labels, spec))


@query("dataset_with_ecg", q(r6(f"""
SELECT b.stay_id, f.* EXCLUDE (stay_id), g.* EXCLUDE (stay_id), o.icu_24h_from_w1 AS y, o.event_by_icu_w1
FROM cohort b JOIN features_w1 f USING (stay_id) JOIN labels o USING (stay_id) LEFT JOIN ecg_w1 g USING (stay_id)
WHERE b.hadm_id IS NOT NULL AND (b.age_at_ed < 90)""", W1_DOUBLES + ecg_doubles("w1"))))
def dataset_with_ecg(t):
    spec = D.DatasetSpec("d", ("W1",), ("icu_24h_from_w1",), "admitted", True, "age_at_ed < 90", include_base=False, missing_threshold=None)
    return rounded(D.assemble(t.staged, t.features(R.W1), t.labels, spec, {"W1": t.ecg(1, "w1")}))


@query("dataset_multi_window", q(r6(f"""
SELECT {_BASE}, f.* EXCLUDE (stay_id, age_at_ed, gender, ed_los_hours), o.death_24h_from_w6 AS y_death_24h_from_w6,
       o.icu_48h_from_w24 AS y_icu_48h_from_w24, o.death_hosp AS y_death_hosp, o.event_by_death_w6, o.event_by_icu_w24
FROM cohort b JOIN ({_BOTH}) f ON f.stay_id = b.stay_id JOIN labels o ON o.stay_id = b.stay_id WHERE b.hadm_id IS NOT NULL""",
    _BOTH_DOUBLES)))
def dataset_multi_window(t):
    spec = D.DatasetSpec("d", ("W6", "W24"), ("death_24h_from_w6", "icu_48h_from_w24", "death_hosp"), "admitted", missing_threshold=None)
    return rounded(D.assemble(t.staged, t.features(R.W6, R.W24), t.labels, spec))




# At 0.40 four columns qualify, with a wide gap to the others; missing_temp_w1 is part of the basket already.
@query("missing_indicators", q(r6("SELECT f.*, b.was_admitted AS y, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS missing_{c}" for c in ("dbp_w1", "shock_index_w1", "map_w1"))
    + " FROM features_w1 f JOIN cohort b USING (stay_id)", W1_DOUBLES)))
def missing_indicators(t):
    df = t.features(R.W1).join(t.staged.select("stay_id", F.col("was_admitted").alias("y")), "stay_id")
    return rounded(X.add_missing_indicators(df, 0.40))


#: columns of the first-hour basket by type, with the label
_W1_TYPES = {
    "bigint": ["stay_id"], "string": ["gender", "arrival_transport", "race", "chiefcomplaint", "triage_pain"], "double": W1_DOUBLES,
    "int": ["age_at_ed", "triage_acuity", "missing_temp_w1", "missing_hr_w1", "missing_sbp_w1", "y"],
}


def _summary_sql() -> str:
    columns = [c for names in _W1_TYPES.values() for c in names]
    empty = " + ".join(f"(avg(({c} IS NULL)::INT) > 0.5)::INT" for c in columns if c != "y")
    types = "".join(f" UNION ALL SELECT 'n_columns_{t}', {len(names)}::DOUBLE" for t, names in _W1_TYPES.items())
    return f"""
WITH d AS (SELECT f.*, b.was_admitted AS y FROM features_w1 f JOIN cohort b USING (stay_id))
SELECT 'n_rows' AS metric, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 'n_positive', sum(y)::DOUBLE FROM d
UNION ALL SELECT 'n_negative', (count(*) - sum(y))::DOUBLE FROM d UNION ALL SELECT 'outcome_rate', avg(y) FROM d
UNION ALL SELECT 'n_over_half_missing', ({empty})::DOUBLE FROM d UNION ALL SELECT 'n_columns', {len(columns)}::DOUBLE{types}"""


@query("dataset_summary", q(r6(_summary_sql(), "value")))
def dataset_summary(t):
    df = t.features(R.W1).join(t.staged.select("stay_id", F.col("was_admitted").alias("y")), "stay_id")
    return rounded(D.dataset_summary(df))


@query("key_alignment", q("""
SELECT b.stay_id, b.age_at_ed, v.n_vitalsign_measurements_24h FROM cohort b JOIN vit_w24 v USING (stay_id)"""))
def key_alignment(t):
    charted = X.vitals_summary(X.with_window_ends(t.staged, [R.W24]), t.src.vitals, [R.W24])
    a, b = D.align_keys(t.staged.select("stay_id", "age_at_ed"), charted.select("stay_id", "n_vitalsign_measurements_24h"))
    return a.join(b, "stay_id")


@query("label_transfer", q(r6(
    "SELECT f.stay_id, f.hr_w1, f.sbp_w1, o.icu_24h_from_w24 AS y FROM features_w1 f JOIN labels o USING (stay_id)", "hr_w1 sbp_w1")))
def label_transfer(t):
    labelled = t.labels.select("stay_id", F.col("icu_24h_from_w24").alias("y"))
    features = t.features(R.W1).select("stay_id", "hr_w1", "sbp_w1", F.lit(None).cast("int").alias("y"))
    return rounded(D.transfer_label(features, labelled))


# --- checks --------------------------------------------------------------------------

_MONO = "\n".join(
    f"UNION ALL SELECT 'event_by_monotonicity_{n}', 'ERROR', stay_id, '{n}' FROM labels "
    f"WHERE event_by_{n}_w1 > event_by_{n}_w6 OR event_by_{n}_w6 > event_by_{n}_w24" for n in Q.EVENT_NAMES)
_VIOLATIONS = f"""
SELECT 'events_before_ed' AS check_name, 'ERROR' AS severity, stay_id, event_type AS detail FROM evlog e JOIN cohort b USING (stay_id)
  WHERE e.event_time < b.ed_intime
UNION ALL SELECT 'icd_events_with_time', 'ERROR', stay_id, event_type FROM evlog
  WHERE event_type IN ('ACS', 'PCI', 'CABG', 'CARDIAC_ARREST') AND event_time IS NOT NULL
{_MONO}
UNION ALL SELECT 'label_event_by_overlap_icu_w6', 'INFO', stay_id, 'icu' FROM labels
  WHERE icu_24h_from_w6 = 1 AND event_by_icu_w6 = 1 AND time_to_icu <= 6
UNION ALL SELECT 'age_out_of_bounds', 'ERROR', stay_id, age_at_ed::VARCHAR FROM cohort WHERE age_at_ed < 18 OR age_at_ed > 110
UNION ALL SELECT 'dead_before_ed', 'ERROR', stay_id, dod::VARCHAR FROM cohort WHERE ed_intime > dod
UNION ALL SELECT 'ecg_outside_ed_window', 'ERROR', stay_id, ecg_time_w6::VARCHAR FROM ecg_w6 JOIN cohort b USING (stay_id)
  WHERE ecg_time_w6 < b.ed_intime OR ecg_time_w6 > b.ed_outtime
UNION ALL SELECT 'death_wrong_source', 'ERROR', stay_id, source_table FROM evlog
  WHERE event_type = 'DEATH' AND source_table <> 'hosp.admissions.deathtime'"""


@query("qa_violations", q(_VIOLATIONS))
def qa_violations(t):
    return Q.qa_violations(t.staged, t.events, t.labels, t.ecg(6, "w6"))


@query("qa_summary", q(f"SELECT check_name, severity, count(*) AS n FROM ({_VIOLATIONS}) GROUP BY 1, 2"))
def qa_summary(t):
    return Q.qa_summary(Q.qa_violations(t.staged, t.events, t.labels, t.ecg(6, "w6")))


_PREV = ("deterioration_24h_from_w6", "icu_24h_from_w6", "death_24h_from_w6", "death_hosp")


@query("sanity_counts", q(r6(f"""
SELECT (SELECT count(*) FROM cohort) AS n_ed_visits, (SELECT count(DISTINCT subject_id) FROM cohort) AS n_unique_patients,
       (SELECT count(*) FROM evlog) AS n_events, (SELECT count(DISTINCT event_type) FROM evlog) AS n_event_types,
       {', '.join(f'(SELECT avg({c}) FROM labels) AS prev_{c}' for c in _PREV)}""", [f"prev_{c}" for c in _PREV])))
def sanity_counts(t):
    return rounded(Q.sanity_counts(t.staged, t.events, t.labels))


_NULLS = ("temp_w1", "hr_w1", "sbp_w1", "spo2_w1")
_CONS = {
    "icu_24h_not_48h_w6": ("icu_24h_from_w6", "icu_48h_from_w6"), "death_24h_not_48h_w6": ("death_24h_from_w6", "death_48h_from_w6"),
    "event_by_icu_w1_not_w6": ("event_by_icu_w1", "event_by_icu_w6"), "event_by_icu_w6_not_w24": ("event_by_icu_w6", "event_by_icu_w24"),
}


@query("consistency_checks", q(f"""
WITH h AS (SELECT {_H} AS h FROM evlog e JOIN cohort b USING (stay_id) WHERE e.event_time IS NOT NULL)
SELECT 'events_before_ed' AS check_name, count(*) FILTER (WHERE h < 0) AS n FROM h
UNION ALL SELECT 'events_early_warning', count(*) FILTER (WHERE h < -1) FROM h UNION ALL SELECT 'total_events', count(*) FROM h
{' '.join(f"UNION ALL SELECT '{n}', count(*) FILTER (WHERE {a} = 1 AND {b} = 0) FROM labels" for n, (a, b) in _CONS.items())}
UNION ALL SELECT 'total_visits', count(*) FROM labels UNION ALL SELECT 'base_count', count(*) FROM cohort
UNION ALL SELECT 'outcome_count', count(*) FROM labels UNION ALL SELECT 'joined_count', count(*) FROM cohort b JOIN labels o USING (stay_id)
{' '.join(f"UNION ALL SELECT 'null_{c}', count(*) FILTER (WHERE {c} IS NULL) FROM features_w1" for c in _NULLS)}"""))
def consistency_checks(t):
    return Q.consistency_checks(t.staged, t.events, t.labels, t.features(R.W1))


@query("join_integrity", q("""
SELECT (SELECT count(*) FROM cohort) AS base_count, (SELECT count(*) FROM untimed_agg) AS outcome_count,
       (SELECT count(*) FROM cohort b JOIN untimed_agg o USING (stay_id)) AS joined_count"""))
def join_integrity(t):
    return Q.join_integrity(t.staged, L.untimed_flags(t.events))


@query("monotonicity", q(r6(" UNION ALL ".join(f"""
SELECT '{n}' AS event, sum(event_by_{n}_w1)::BIGINT AS n_w1, sum(event_by_{n}_w6)::BIGINT AS n_w6, sum(event_by_{n}_w24)::BIGINT AS n_w24,
       100.0::DOUBLE * avg(event_by_{n}_w1) AS pct_w1, 100.0::DOUBLE * avg(event_by_{n}_w6) AS pct_w6, 100.0::DOUBLE * avg(event_by_{n}_w24) AS pct_w24,
       count(*) FILTER (WHERE event_by_{n}_w1 > event_by_{n}_w6) AS w1_above_w6,
       count(*) FILTER (WHERE event_by_{n}_w6 > event_by_{n}_w24) AS w6_above_w24 FROM labels""" for n in Q.EVENT_NAMES),
    "pct_w1 pct_w6 pct_w24")))
def monotonicity(t):
    return rounded(Q.event_by_statistics(t.labels))


@query("label_flag_overlap", q("SELECT " + ", ".join(
    f"count(*) FILTER (WHERE event_by_{n}_w6 = 1) AS {n}_by_w6, count(*) FILTER (WHERE {n}_24h_from_w6 = 1) AS {n}_after_w6, "
    f"count(*) FILTER (WHERE event_by_{n}_w6 = 1 AND {n}_24h_from_w6 = 1) AS {n}_both" for n in ("icu", "deterioration")) + " FROM labels"))
def label_flag_overlap(t):
    return Q.label_flag_overlap(t.labels)


_PAIRS = [("icu_24h_from_w6", "pressor_24h_from_w6"), ("icu_24h_from_w6", "vent_24h_from_w6"), ("pressor_24h_from_w6", "vent_24h_from_w6")]


@query("cooccurrence", q(r6(" UNION ALL ".join(
    f"SELECT '{a} + {b}' AS combination, count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS n, "
    f"avg(CASE WHEN {a} = 1 AND {b} = 1 THEN 1.0 ELSE 0.0 END) AS prevalence FROM labels" for a, b in _PAIRS), "prevalence")))
def cooccurrence(t):
    return rounded(L.cooccurrence(t.labels, _PAIRS))


_PREVALENCE = ("death_hosp", "cardiac_arrest_hosp", "acs_hosp", "revasc_hosp", "coronary_event_hosp", "icu_24h_from_w1", "icu_24h_from_w6",
               "icu_24h_from_w24", "deterioration_24h_from_w1", "deterioration_24h_from_w6", "deterioration_24h_from_w24",
               "deterioration_48h_from_w24", "death_24h_from_w6", "event_by_deterioration_w1", "event_by_deterioration_w6",
               "event_by_deterioration_w24", "event_by_icu_w1", "event_by_icu_w6", "event_by_icu_w24", *TIME_COLS)


@query("label_prevalence", q(r6(
    "SELECT count(*) AS total_visits, " + ", ".join(f"avg({c}) AS prev_{c}" for c in _PREVALENCE) + " FROM labels",
    [f"prev_{c}" for c in _PREVALENCE])))
def label_prevalence(t):
    return rounded(L.prevalence(t.labels, _PREVALENCE))


_NR = ["stay_id", "age_at_ed", "temp_w1", "hr_w1", "rr_w1", "spo2_w1", "sbp_w1", "dbp_w1", "triage_acuity", "shock_index_w1", "map_w1",
       "missing_temp_w1", "missing_hr_w1", "missing_sbp_w1"]


@query("null_rates", q(r6(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM features_w1" for c in _NR), "null_rate")))
def null_rates(t):
    return rounded(Q.null_rates(t.features(R.W1)))


_VS = ("hr_w1", "sbp_w1", "rr_w1", "spo2_w1", "temp_w1")


@query("vital_summary", q(r6(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) AS min_value, avg({c}) AS mean_value, max({c}) AS max_value FROM features_w1" for c in _VS),
    "min_value mean_value max_value")))
def vital_summary(t):
    return rounded(Q.vital_summary(t.features(R.W1), _VS))


@query("ecg_profile", q(r6("""
SELECT count(*) AS n_total, count(*) FILTER (WHERE missing_ecg_w6 = 0) AS n_with_ecg,
       avg(CASE WHEN missing_ecg_w6 = 0 THEN 1.0 ELSE 0.0 END) AS coverage, avg(ecg_hr_w6) AS mean_hr, min(ecg_hr_w6) AS min_hr,
       max(ecg_hr_w6) AS max_hr, avg(ecg_qrs_dur_w6) AS mean_qrs, quantile_cont(ecg_hr_w6, 0.5) AS median_hr,
       quantile_cont(ecg_qrs_dur_w6::DOUBLE, 0.5) AS median_qrs FROM ecg_w6""",
    "coverage mean_hr min_hr max_hr mean_qrs median_hr median_qrs")))
def ecg_profile(t):
    ecg = t.ecg(6, "w6").select("missing_ecg_w6", "ecg_hr_w6", "ecg_qrs_dur_w6")
    medians = P.exact_quantiles(P.frequencies(ecg, ["ecg_hr_w6", "ecg_qrs_dur_w6"]), ["column_name"], "value", "n", {"m": 0.5}).agg(
        F.max(F.when(F.col("column_name") == "ecg_hr_w6", F.col("m"))).alias("median_hr"),
        F.max(F.when(F.col("column_name") == "ecg_qrs_dur_w6", F.col("m"))).alias("median_qrs"),
    )
    one = F.lit(1).alias("_one")
    return rounded(G.ecg_profile(ecg, "w6").select("*", one).join(medians.select("*", one), "_one").drop("_one"))


@query("ecg_coverage_by_outcome", q(r6("""
SELECT o.was_admitted AS y, count(*) AS n_total, count(*) FILTER (WHERE missing_ecg_w6 = 0) AS n_with_ecg,
       avg(CASE WHEN missing_ecg_w6 = 0 THEN 1.0 ELSE 0.0 END) AS coverage
FROM cohort o JOIN ecg_w6 e USING (stay_id) GROUP BY 1""", "coverage")))
def ecg_coverage_by_outcome(t):
    return rounded(G.coverage_by(t.staged, t.ecg(6, "w6"), "was_admitted", "w6"))


@query("adhoc_checks", q(r6("""
SELECT (SELECT count(*) FROM cohort) AS n_cohort, (SELECT count(*) - count(DISTINCT stay_id) FROM cohort) AS duplicate_stays,
       (SELECT count(*) FROM labels) AS n_labels, (SELECT avg(CASE WHEN hr_mean_6h IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM features_w6) AS vitals_coverage,
       (SELECT avg(CASE WHEN missing_ecg_w6 = 0 THEN 1.0 ELSE 0.0 END) FROM ecg_w6) AS ecg_coverage""", "vitals_coverage ecg_coverage")))
def adhoc_checks(t):
    return rounded(Q.adhoc_checks(t.staged, t.labels, t.features(R.W6), t.ecg(6, "w6")))


# --- cohort reports ------------------------------------------------------------------

_QTILE = ", ".join(f"quantile_cont({{c}}::DOUBLE, {p}) AS {n}" for n, p in P.QUARTILES.items())
_NOQ = "NULL AS q25, NULL AS median, NULL AS q75"


@query("cohort_table", q(r6(f"""
WITH n AS (SELECT count(*) AS total FROM cohort)
SELECT 'female' AS variable, '1' AS level, count(*) FILTER (WHERE gender = 'F') AS n,
       100.0::DOUBLE * count(*) FILTER (WHERE gender = 'F') / count(*) AS pct, {_NOQ} FROM cohort
UNION ALL SELECT 'admitted', '1', count(*) FILTER (WHERE was_admitted = 1), 100.0::DOUBLE * count(*) FILTER (WHERE was_admitted = 1) / count(*), {_NOQ} FROM cohort
UNION ALL SELECT 'age_at_ed', 'median', count(age_at_ed), 100.0::DOUBLE * count(age_at_ed) / count(*), {_QTILE.format(c='age_at_ed')} FROM cohort
UNION ALL SELECT 'ed_los_hours', 'median', count(ed_los_hours), 100.0::DOUBLE * count(ed_los_hours) / count(*), {_QTILE.format(c='ed_los_hours')} FROM cohort
UNION ALL SELECT 'race', race, count(*), 100.0::DOUBLE * count(*) / (SELECT total FROM n), {_NOQ} FROM cohort GROUP BY race
UNION ALL SELECT 'arrival_transport', arrival_transport, count(*), 100.0::DOUBLE * count(*) / (SELECT total FROM n), {_NOQ}
  FROM cohort GROUP BY arrival_transport""", "pct q25 median q75")))
def cohort_table(t):
    flags = {"female": F.col("gender") == "F", "admitted": F.col("was_admitted") == 1}
    return rounded(P.cohort_table(t.staged, ["age_at_ed", "ed_los_hours"], flags, ["race", "arrival_transport"]))


_OUT = ("death_hosp", "icu_24h_from_w6", "deterioration_24h_from_w6")


@query("cohort_descriptives", q(r6(f"""
SELECT count(*) AS n_stays, count(DISTINCT b.subject_id) AS n_subjects, avg(age_at_ed) AS age_mean, stddev_samp(age_at_ed) AS age_std,
       avg(CASE WHEN gender = 'M' THEN 1.0 ELSE 0.0 END) AS male_rate, avg(was_admitted) AS admission_rate, avg(ed_los_hours) AS los_mean,
       {', '.join(f'avg(o.{c}) AS rate_{c}' for c in _OUT)}
FROM cohort b JOIN labels o USING (stay_id)""", ["age_mean", "age_std", "male_rate", "admission_rate", "los_mean", *[f"rate_{c}" for c in _OUT]])))
def cohort_descriptives(t):
    return rounded(P.cohort_descriptives(t.staged, t.labels, _OUT))


_AGE = "CASE WHEN age_at_ed < 30 THEN '18-29' WHEN age_at_ed < 50 THEN '30-49' WHEN age_at_ed < 65 THEN '50-64' WHEN age_at_ed < 80 THEN '65-79' ELSE '80+' END"


@query("rates_by_age_group", q(r6(f"""
SELECT {_AGE} AS age_group, count(*) AS n, avg(was_admitted) AS admission_rate FROM cohort GROUP BY 1""", "admission_rate")))
def rates_by_age_group(t):
    group = P.binned(F.col("age_at_ed"), P.AGE_EDGES, P.AGE_NAMES, right=False)
    return rounded(P.rates_by(t.cohort, {"age_group": group}, {"admission_rate": F.col("was_admitted")}))


@query("rates_by_gender_and_age", q(r6("""
SELECT b.gender, CASE WHEN b.age_at_ed >= 65 THEN 'Elderly' ELSE 'Non-elderly' END AS age_class, count(*) AS n,
       avg(o.deterioration_24h_from_w6) AS det_rate, avg(o.icu_24h_from_w6) AS icu_rate, avg(o.death_24h_from_w6) AS death_rate
FROM cohort b JOIN labels o USING (stay_id) WHERE b.was_admitted = 1 GROUP BY 1, 2""", "det_rate icu_rate death_rate")))
def rates_by_gender_and_age(t):
    outcomes = {"det_rate": "deterioration_24h_from_w6", "icu_rate": "icu_24h_from_w6", "death_rate": "death_24h_from_w6"}
    df = t.staged.where("was_admitted = 1").join(t.labels.select("stay_id", *outcomes.values()), "stay_id")
    age = F.when(F.col("age_at_ed") >= 65, "Elderly").otherwise("Non-elderly")
    return rounded(P.rates_by(df, {"gender": F.col("gender"), "age_class": age}, {n: F.col(c) for n, c in outcomes.items()}))


@query("time_histogram", q("""
SELECT bucket_rank, ['0-6h', '6-12h', '12-24h', '24-48h', '>48h'][bucket_rank + 1] AS bucket, count(*) AS n
FROM (SELECT CASE WHEN time_to_icu <= 6 THEN 0 WHEN time_to_icu <= 12 THEN 1 WHEN time_to_icu <= 24 THEN 2 WHEN time_to_icu <= 48 THEN 3 ELSE 4 END AS bucket_rank
      FROM labels WHERE time_to_icu IS NOT NULL) GROUP BY 1"""))
def time_histogram(t):
    return P.time_histogram(t.labels, F.col("time_to_icu"))


_ECG_MEANS = {"mean_hr": "ecg_hr_w6", "mean_qrs": "ecg_qrs_dur_w6", "mean_pr": "ecg_pr_w6", "mean_qt": "ecg_qt_w6", "missing_rate": "missing_ecg_w6"}


@query("ecg_means_by_label", q(r6(f"""
SELECT o.deterioration_24h_from_w6 AS deteriorated, count(*) AS n, {', '.join(f'avg({c}) AS {n}' for n, c in _ECG_MEANS.items())}
FROM labels o JOIN ecg_w6 e USING (stay_id) WHERE o.hadm_id IS NOT NULL GROUP BY 1""", list(_ECG_MEANS))))
def ecg_means_by_label(t):
    df = t.labels.where("hadm_id IS NOT NULL").select("stay_id", "deterioration_24h_from_w6").join(t.ecg(6, "w6"), "stay_id")
    return rounded(P.rates_by(df, {"deteriorated": F.col("deterioration_24h_from_w6")}, {n: F.col(c) for n, c in _ECG_MEANS.items()}))


@query("subgroup_rates", q(r6("""
SELECT CASE WHEN f.troponin_first_24h IS NOT NULL THEN 'measured' ELSE 'not measured' END AS workup, count(*) AS n,
       avg(o.deterioration_24h_from_w24) AS det_rate, avg(o.death_24h_from_w24) AS death_rate
FROM labels o JOIN features_w24 f USING (stay_id) JOIN cohort b USING (stay_id) WHERE b.was_admitted = 1 GROUP BY 1""", "det_rate death_rate")))
def subgroup_rates(t):
    df = (
        t.labels.select("stay_id", "hadm_id", "deterioration_24h_from_w24", "death_24h_from_w24").where("hadm_id IS NOT NULL")
        .join(t.features(R.W24).select("stay_id", "troponin_first_24h"), "stay_id")
    )
    workup = F.when(F.col("troponin_first_24h").isNotNull(), "measured").otherwise("not measured")
    return rounded(P.rates_by(df, {"workup": workup}, {"det_rate": F.col("deterioration_24h_from_w24"), "death_rate": F.col("death_24h_from_w24")}))
