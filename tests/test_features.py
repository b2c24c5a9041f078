from datetime import datetime, timedelta

import pytest

from tidemark import rules as R
from tidemark.operators import features as X
from tidemark.operators.cohort import build_cohort
from tidemark.operators.ecg import build_ecg_features
from tests.helpers import T0, US, by_key, h, person, sources, stay


def make(spark, stays=None, **rows):
    stays = stays or [stay(1, 1, 100, outtime=h(4)), stay(2, 2, None)]
    src = sources(spark, stays=stays, persons=[person(i) for i in {s["subject_id"] for s in stays}], **rows)
    return src, build_cohort(src.stays, src.persons)


def vital(t, stay_id=1, **kw):
    return {"stay_id": stay_id, "charttime": t, **kw}


def lab(t, itemid, value, hadm_id=100):
    return {"hadm_id": hadm_id, "subject_id": 1, "itemid": itemid, "charttime": t, "valuenum": value}


ITEMS = [{"itemid": 1, "label": "Lactate"}, {"itemid": 51003, "label": "TROPONIN T"}, {"itemid": 3, "label": "Troponin I"},
         {"itemid": 4, "label": "Hemoglobin creatinine"}, {"itemid": 5, "label": "Glucose"}]


def test_vitals_window_is_clamped_to_departure(spark):
    src, c = make(spark, vitals=[vital(T0, sbp=100.0), vital(h(4), sbp=120.0), vital(h(4) + US, sbp=500.0), vital(T0 - US, sbp=1.0)])
    r = by_key(X.build_features(c, src, [R.W6]))
    assert (r[1].sbp_min_6h, r[1].sbp_max_6h, r[1].sbp_mean_6h, r[1].n_vitalsign_measurements_6h) == (100.0, 120.0, 110.0, 2)
    assert r[1].sbp_cv_6h == pytest.approx(r[1].sbp_std_6h / 110.0)
    assert r[2].n_vitalsign_measurements_6h == 0 and r[2].sbp_min_6h is None


def test_single_measurement_has_no_deviation(spark):
    src, c = make(spark, vitals=[vital(h(1), heartrate=80.0, sbp=100.0)])
    r = by_key(X.build_features(c, src, [R.W6]))[1]
    assert r.hr_std_6h is None and r.sbp_cv_6h is None and r.hr_range_6h == 0.0


def test_first_lab_is_ranked_inside_the_window(spark):
    labs = [lab(T0 - US, 1, 9.0), lab(h(1), 1, 3.0), lab(h(1), 1, 2.0), lab(h(2), 1, 8.0), lab(h(0.5), 1, 0.0), lab(h(0.5), 1, None),
            lab(h(2), 3, 5.0), lab(h(3), 51003, 6.0), lab(h(1), 4, 1.5), lab(h(0.2), 5, 99.0)]
    src, c = make(spark, labs=labs, lab_items=ITEMS)
    r6 = by_key(X.build_features(c, src, [R.W6]))[1]
    # ties go to the smaller value; "Hemoglobin creatinine" is creatinine, the first rule
    assert (r6.lactate_first_6h, r6.troponin_first_6h, r6.is_hs_troponin_6h, r6.creatinine_first_6h, r6.hemoglobin_first_6h) == (2.0, 5.0, 0, 1.5, None)
    assert r6.time_to_first_lab_hours == 1.0  # glucose is not part of this basket
    assert (r6.missing_lactate_6h, r6.missing_troponin_6h) == (0, 0)
    r24 = by_key(X.build_features(c, src, [R.W24]))[1]
    assert (r24.lactate_max_24h, r24.lactate_delta_24h, r24.glucose_first_24h, r24.time_to_first_lab_hours) == (8.0, 6.0, 99.0, 0.2)


def test_high_sensitivity_flag_follows_the_first_troponin(spark):
    src, c = make(spark, labs=[lab(h(1), 51003, 5.0), lab(h(2), 3, 6.0)], lab_items=ITEMS)
    assert by_key(X.build_features(c, src, [R.W6]))[1].is_hs_troponin_6h == 1


def test_medication_time(spark):
    src, c = make(spark, medications=[{"stay_id": 1, "charttime": h(3)}, {"stay_id": 1, "charttime": h(2)}, {"stay_id": 1, "charttime": T0 - US}])
    r = by_key(X.build_features(c, src, [R.W6]))
    assert r[1].time_to_first_med_hours == 2.0 and r[2].time_to_first_med_hours is None


def test_first_hour_prefers_triage(spark):
    src, c = make(
        spark,
        triage=[{"stay_id": 1, "heartrate": 90.0, "sbp": None, "dbp": 60.0, "chiefcomplaint": "x", "pain": "3", "acuity": 2}],
        vitals=[vital(h(0.5), heartrate=70.0, sbp=120.0), vital(h(0.2), heartrate=60.0, sbp=None, temperature=98.0), vital(h(1) + US, sbp=1.0)])
    r = by_key(X.build_features(c, src, [R.W1]))
    # the first charted row counts as a whole, even where it has gaps
    assert (r[1].hr_w1, r[1].sbp_w1, r[1].temp_w1, r[1].map_w1, r[1].shock_index_w1) == (90.0, None, 98.0, None, None)
    assert (r[1].missing_hr_w1, r[1].missing_sbp_w1, r[2].missing_temp_w1) == (0, 1, 1)
    assert r[1].chiefcomplaint == "x" and r[2].chiefcomplaint is None


def test_prior_history(spark):
    t = datetime(2024, 2, 29, 10)
    year = datetime(2023, 2, 28, 10)
    stays = [stay(1, 1, 100, t), stay(2, 1, None, t), stay(3, 1, 101, year), stay(4, 1, 102, year - US), stay(5, 1, 103, datetime(2023, 6, 1), outtime=datetime(2023, 5, 1))]
    adm = [{"subject_id": 1, "hadm_id": 100, "admittime": t - timedelta(hours=1)}, {"subject_id": 1, "hadm_id": 101, "admittime": year},
           {"subject_id": 1, "hadm_id": 102, "admittime": year - US}, {"subject_id": 1, "hadm_id": 104, "admittime": t}]
    src, c = make(spark, stays, admissions=adm)
    r = by_key(X.prior_history(c, src.admissions, src.stays))
    assert 5 not in r
    # own admission is left out, exactly one year counts, arrival itself does not; stay 5 is no cohort member but a visit
    assert (r[1].prev_admits_1yr, r[1].prev_ed_visits_1yr) == (1, 2)
    # without an own admission nothing compares as different
    assert (r[2].prev_admits_1yr, r[2].prev_ed_visits_1yr) == (0, 2)


def test_prior_history_counts_a_repeated_id_once(spark):
    t = datetime(2024, 6, 1, 10)
    stays = [stay(1, 1, 100, t)]
    adm = [{"subject_id": 1, "hadm_id": 101, "admittime": t - timedelta(days=d)} for d in (10, 20, 800)]
    adm += [{"subject_id": 1, "hadm_id": 100, "admittime": t - timedelta(hours=d)} for d in (1, 2)]
    src, c = make(spark, stays, admissions=adm)
    rows = X.prior_history(c, src.admissions, src.stays).collect()
    assert [(r.stay_id, r.prev_admits_1yr) for r in rows] == [(1, 1)]


LABELS = "stay_id long, time_to_deterioration double"


def test_truncation_at_the_first_event(spark):
    stays = [stay(i, i, 100 + i, outtime=h(5)) for i in (1, 2, 3, 4, 5)]
    vitals = [vital(t, i, sbp=s) for i in (1, 2, 3, 4, 5) for t, s in ((T0, 100.0), (h(2), 110.0), (h(2) + US, 120.0), (h(5), 130.0), (h(5.5), 140.0))]
    src, c = make(spark, stays, vitals=vitals)
    labels = spark.createDataFrame([(1, None), (2, 2.0), (3, 0.0), (4, 9.0)], LABELS)
    ends = X.truncated_ends(c, labels, [R.W6])
    r = by_key(X.build_features(c, src, [R.W6], ends=ends))
    assert {s: r[s].sbp_max_6h for s in r} == {1: 130.0, 2: 110.0, 3: 100.0, 4: 130.0}  # stay 5 has no labels
    loose = by_key(X.build_features(c, src, [R.W6], ends=X.truncated_ends(c, labels, [R.W6], clamp=False)))
    assert loose[1].sbp_max_6h == 140.0
    naive = by_key(X.build_features(c, src, [R.W6]))
    assert all(r[s].n_vitalsign_measurements_6h <= naive[s].n_vitalsign_measurements_6h for s in r)


def test_ranking_by_admission_loses_early_firsts(spark):
    src, c = make(spark, labs=[lab(T0 - US, 1, 9.0), lab(h(1), 1, 3.0), lab(h(1), 3, 4.0)], lab_items=ITEMS)
    ends = X.truncated_ends(c, spark.createDataFrame([(1, None), (2, None)], LABELS), [R.W24], clamp=False)
    r = by_key(X.build_features(c, src, [R.W24], ends=ends, rank_by_admission=True))[1]
    assert (r.lactate_first_24h, r.troponin_first_24h, r.lactate_max_24h, r.time_to_first_lab_hours) == (None, 4.0, 3.0, 1.0)


def test_column_contracts(spark):
    src, c = make(spark)
    for spec, n in ((R.W1, 19), (R.W6, 41), (R.W24, 42)):
        out = X.build_features(c, src, [spec])
        assert out.columns == X.basket_columns(spec)
        assert len(out.columns) == n
        assert out.count() == 2


def test_several_windows_in_one_pass_equal_single_windows(spark):
    src, c = make(spark, vitals=[vital(h(i), sbp=100.0 + i, heartrate=60.0 + i) for i in (0, 0.5, 1, 3)], lab_items=ITEMS,
                  labs=[lab(h(0.5), 1, 2.0), lab(h(3), 1, 5.0)], medications=[{"stay_id": 1, "charttime": h(2)}],
                  triage=[{"stay_id": 1, "chiefcomplaint": "c"}])
    specs = [R.W1, R.W6, R.W24]
    wide = X.build_features(c, src, specs)
    assert "race_w6" in wide.columns and "age_at_ed" in wide.columns and "sbp_max_6h" in wide.columns
    for spec in specs:
        one = X.build_features(c, src, [spec])
        again = X.baskets_from(wide, specs, [spec])
        assert again.columns == one.columns
        assert sorted(map(str, again.collect())) == sorted(map(str, one.collect()))


def test_options_and_validation(spark):
    spec = R.WindowSpec("o", 6, "6h", last_vitals=("hr",), delta_vitals=("hr",), time_to_first_vital=True, ranges=(("hr", 20.0, 250.0),), process=False, history=False)
    src, c = make(spark, vitals=[vital(h(1), heartrate=999.0), vital(h(2), heartrate=70.0), vital(h(3), heartrate=90.0), vital(h(3.5), heartrate=None)])
    r = by_key(X.vitals_summary(X.with_window_ends(c, [spec]), src.vitals, [spec]))[1]
    assert (r.hr_last_6h, r.delta_hr_6h, r.time_to_first_vital_6h) == (90.0, 20.0, 1.0)
    with pytest.raises(ValueError):
        R.WindowSpec("x", 0, "x")
    with pytest.raises(ValueError):
        R.WindowSpec("x", 1, "x", vitals=(("pulse", ("min",)),))


def test_missing_indicators_threshold(spark):
    df = spark.createDataFrame([(1, None, None, 1, None, 1), (2, 1, 1, 1, None, 0), (3, 1, None, None, 1, 0), (4, 1, None, None, 1, 1)],
                               "stay_id int, a int, b int, c int, missing_x int, y int")
    out = X.add_missing_indicators(df, 0.5)
    assert out.columns == [*df.columns, "missing_b", "missing_c"]
    assert [r.missing_c for r in out.orderBy("stay_id").collect()] == [0, 0, 1, 1]
    assert "missing_a" in X.add_missing_indicators(df, 0.25).columns


def test_ecg_first_in_window(spark):
    stays = [stay(1, 1, 100, outtime=h(4)), stay(2, 2, None), stay(3, 3, None), stay(4, 4, None)]
    study = lambda s, i, t: {"subject_id": s, "study_id": i, "ecg_time": t}
    src, c = make(spark, stays, ecg_studies=[
        study(1, 12, h(1)), study(1, 11, h(1)), study(1, 13, h(0) - US), study(2, 21, h(6)), study(3, 31, h(6) + US), study(4, 41, None)],
        ecg_measurements=[{"study_id": 11, "rr_interval": 600.0, "qrs_onset": 100.0, "qrs_end": 190.0, "p_onset": None, "t_end": 480.0},
                          {"study_id": 21, "rr_interval": 0.0}])
    r = by_key(build_ecg_features(c, src.ecg_studies, src.ecg_measurements, 6, "w6"))
    assert (r[1].ecg_study_id_w6, r[1].ecg_hr_w6, r[1].ecg_qrs_dur_w6, r[1].ecg_pr_w6, r[1].ecg_qt_w6) == (11, 100.0, 90.0, None, 380.0)
    assert (r[2].ecg_study_id_w6, r[2].ecg_hr_w6, r[2].missing_ecg_w6) == (21, None, 0)
    assert (r[3].ecg_study_id_w6, r[3].missing_ecg_w6, r[4].missing_ecg_w6) == (None, 1, 1)
