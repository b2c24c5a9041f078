from datetime import timedelta

from tidemark import rules as R
from tidemark.operators import events as E
from tidemark.operators.cohort import build_cohort
from tests.helpers import T0, US, h, person, sources, stay

OUT = T0 + timedelta(hours=12)
LAST = OUT + timedelta(days=7)


def setup(spark, **rows):
    src = sources(spark, stays=[stay(1, 1, 100), stay(2, 2, None), stay(3, 3, 100, intime=h(48))],
                  persons=[person(1), person(2), person(3)], **rows)
    return src, build_cohort(src.stays, src.persons)


def test_icu_interval_is_closed_and_every_unit_stay_counts(spark):
    times = [T0 - US, T0, OUT, LAST, LAST + US, None]
    src, c = setup(spark, unit_stays=[{"hadm_id": 100, "intime": t, "first_careunit": str(i)} for i, t in enumerate(times)])
    got = E.icu_admissions(c, src.unit_stays).collect()
    assert sorted(r.event_detail for r in got if r.stay_id == 1) == ["1", "2", "3"]
    # a second stay of the same admission gets what lies in its own interval
    assert sorted(r.event_detail for r in got if r.stay_id == 3) == ["3", "4"]
    assert all(r.event_time_type == "exact" for r in got)


def test_pressors_first_start_and_distinct_labels(spark):
    items = [{"itemid": 1, "label": "NorEpinephrine"}, {"itemid": 2, "label": "Dopamine"}, {"itemid": 3, "label": "Saline"}]
    give = lambda t, i, amount=1.0: {"hadm_id": 100, "starttime": t, "itemid": i, "amount": amount}
    src, c = setup(spark, items=items, inputs=[
        give(h(3), 2), give(h(2), 1), give(h(4), 1), give(h(1), 3), give(h(0.5), 1, 0.0), give(T0 - US, 2), give(None, 2)])
    (r,) = [x for x in E.pressor_starts(c, src.inputs, src.items).collect() if x.stay_id == 1]
    assert r.event_time == h(2) and r.event_detail == "Dopamine; NorEpinephrine"


def test_ventilation_uses_both_sources(spark):
    items = [{"itemid": 1, "label": "Intubation"}, {"itemid": 2, "label": "PEEP set"}, {"itemid": 3, "label": "Hemodialysis"}]
    src, c = setup(
        spark, items=items,
        procedure_events=[{"hadm_id": 100, "starttime": h(5), "itemid": 1}, {"hadm_id": 100, "starttime": h(1), "itemid": 2}],
        chart_events=[{"hadm_id": 100, "charttime": h(2), "itemid": 2, "value": None}, {"hadm_id": 100, "charttime": h(4), "itemid": 2, "value": "5"},
                      {"hadm_id": 100, "charttime": h(3), "itemid": 3, "value": "x"}])
    vent = [r for r in E.ventilation_starts(c, src.procedure_events, src.chart_events, src.items).collect() if r.stay_id == 1]
    assert [(r.event_time, r.event_detail) for r in vent] == [(h(4), "Intubation; PEEP set")]
    rrt = [r for r in E.rrt_starts(c, src.procedure_events, src.chart_events, src.items).collect() if r.stay_id == 1]
    assert [(r.event_time, r.event_detail) for r in rrt] == [(h(3), "Hemodialysis")]


CODES = [
    {"icd_code": "I214", "icd_version": 10, "long_title": "a"}, {"icd_code": "I200", "icd_version": 10, "long_title": "unstable"},
    {"icd_code": "41071", "icd_version": 9, "long_title": "b"}, {"icd_code": "41071", "icd_version": 10, "long_title": "wrong version"},
    {"icd_code": "I469", "icd_version": 10, "long_title": "arrest"}, {"icd_code": "I2", "icd_version": 10, "long_title": "no"},
]


def test_code_events_are_untimed_and_grouped_by_type(spark):
    dx = [{"hadm_id": 100, "icd_code": c, "icd_version": v} for c, v in
          [("I214", 10), ("I214", 10), ("41071", 9), ("41071", 10), ("I469", 10), ("I200", 10), ("I2", 10)]]
    src, c = setup(spark, diagnosis_codes=CODES, diagnoses=dx)
    got = {(r.stay_id, r.event_type): r for r in E.code_events(c, src.diagnoses, src.diagnosis_codes, R.DIAGNOSIS_RULES, "s").collect()}
    assert set(got) == {(s, t) for s in (1, 3) for t in ("ACS", "CARDIAC_ARREST")}
    acs = got[1, "ACS"]
    assert acs.event_detail == "a; b" and acs.event_time is None and acs.event_time_type == "none"
    dotless = E.code_events(c, src.diagnoses, src.diagnosis_codes, R.DIAGNOSIS_RULES, "s", normalize=True)
    assert {r.event_detail for r in dotless.collect() if r.event_type == "ACS"} == {"a; b; unstable"}


def test_deaths_have_no_upper_bound(spark):
    late = h(24 * 400)
    src, c = setup(spark, admissions=[{"hadm_id": 100, "subject_id": 1, "deathtime": late}])
    assert {r.stay_id: r.event_time for r in E.deaths(c, src.admissions).collect()} == {1: late, 3: late}
    src, c = setup(spark, admissions=[{"hadm_id": 100, "subject_id": 1, "deathtime": T0}])
    assert {r.stay_id for r in E.deaths(c, src.admissions).collect()} == {1}


def test_log_contract_and_reports(spark):
    src, c = setup(spark, unit_stays=[{"hadm_id": 100, "intime": h(1), "first_careunit": "A"}, {"hadm_id": 100, "intime": h(50), "first_careunit": "B"}],
                   admissions=[{"hadm_id": 100, "deathtime": h(60)}], diagnosis_codes=CODES, diagnoses=[{"hadm_id": 100, "icd_code": "I469", "icd_version": 10}])
    log = E.build_event_log(c, src)
    assert tuple(log.columns) == E.LOG_COLUMNS
    counts = {r.event_type: (r.n, round(r.pct, 3)) for r in E.event_counts(log).collect()}
    assert counts == {"ICU_ADMIT": (3, 42.857), "DEATH": (2, 28.571), "CARDIAC_ARREST": (2, 28.571)}
    p = E.event_timing_profile(log, c).first()
    assert (p.total_events, p.visits_with_events, p.events_before_ed, p.events_within_24h) == (5, 2, 0, 3)
    assert {r.pattern: r.n for r in E.event_type_patterns(log, ["%_ADMIT"]).collect()} == {"total": 7, "null_types": 0, "%_ADMIT": 3}
    m = E.code_match_counts(src.diagnoses, src.diagnosis_codes, R.DIAGNOSIS_RULES).collect()
    assert [(r.event_type, r.n_rows, r.n_admissions) for r in m] == [("CARDIAC_ARREST", 1, 1)]
