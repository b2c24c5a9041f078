import pytest

from tidemark import rules as R
from tidemark.operators import dataset as D
from tidemark.operators import features as X
from tidemark.operators.cohort import build_cohort
from tidemark.operators.events import build_event_log
from tidemark.operators.labels import build_labels, infer_event_by_columns
from tidemark.plans import presets as P
from tidemark.plans.run import run
from tests.helpers import T0, h, person, sources, stay

ROWS = dict(
    stays=[stay(1, 1, 101), stay(2, 2, 102), stay(3, 3, None)],
    persons=[person(1), person(2, 80), person(3)],
    vitals=[{"stay_id": s, "charttime": h(i), "sbp": 100.0 + i, "heartrate": 70.0} for s in (1, 2, 3) for i in (0, 2, 5)],
    triage=[{"stay_id": 1, "heartrate": 99.0, "chiefcomplaint": "c"}],
    unit_stays=[{"hadm_id": 101, "intime": h(8), "first_careunit": "A"}, {"hadm_id": 102, "intime": h(3), "first_careunit": "B"}],
    admissions=[{"subject_id": 1, "hadm_id": 101, "admittime": T0}, {"subject_id": 2, "hadm_id": 102, "admittime": T0, "deathtime": h(20)}],
    ecg_studies=[{"subject_id": 1, "study_id": 5, "ecg_time": h(0.5)}],
    ecg_measurements=[{"subject_id": 1, "study_id": 5, "rr_interval": 500.0}],
)


@pytest.fixture(scope="module")
def stages(spark):
    src = sources(spark, **ROWS)
    cohort = build_cohort(src.stays, src.persons)
    return src, cohort, build_labels(cohort, build_event_log(cohort, src))


def test_single_outcome(stages):
    src, cohort, labels = stages
    spec = D.DatasetSpec("d", ("W6",), ("icu_24h_from_w6",), missing_threshold=None)
    df = D.assemble(cohort, X.build_features(cohort, src, [R.W6]), labels, spec)
    assert len(df.columns) == len(set(df.columns))
    assert df.columns[:8] == list(X.BASE_COLUMNS) and df.columns[-2:] == ["y", "event_by_icu_w6"]
    assert {r.stay_id: (r.y, r.event_by_icu_w6) for r in df.collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_several_windows_and_outcomes(stages):
    src, cohort, labels = stages
    spec = D.DatasetSpec("d", ("W1", "W6"), ("icu_24h_from_w6", "death_hosp"), "admitted", where="age_at_ed >= 60")
    df = D.assemble(cohort, X.build_features(cohort, src, [R.W1, R.W6]), labels, spec)
    assert {"chiefcomplaint_w1", "chiefcomplaint_w6", "race_w1", "y_icu_24h_from_w6", "y_death_hosp", "event_by_icu_w6"} <= set(df.columns)
    assert "y" not in df.columns and "missing_lactate_first_6h" in df.columns and "missing_y_death_hosp" not in df.columns
    assert [(r.stay_id, r.y_death_hosp) for r in df.collect()] == [(2, 1)]


def test_spec_validation(stages):
    _, cohort, labels = stages
    with pytest.raises(ValueError):
        D.DatasetSpec("d", ("W2",), ("y",))
    with pytest.raises(ValueError):
        D.DatasetSpec("d", ("W6",), ("icu_24h_from_w6",), "nobody")
    with pytest.raises(ValueError):
        D.DatasetSpec("d", ("W6",), ("deterioration_24h",)).check_outcomes(labels)


def test_every_preset_resolves(stages):
    _, _, labels = stages
    assert [len(x) for x in (P.PRESETS, P.CONFIGURED, P.PHENOTYPES, P.EXPERIMENTS)] == [17, 16, 2, 13]
    for registry in (P.PRESETS, P.CONFIGURED, P.PHENOTYPES, P.EXPERIMENTS):
        for name, spec in registry.items():
            assert spec.name == name
            spec.check_outcomes(labels)
    spec = P.spec_from_dict("x", {"window": "W6", "outcome": "acs_hosp", "cohort_type": "admitted", "filter": "age_at_ed > 1"})
    assert (spec.windows, spec.outcomes, spec.missing_threshold) == (("W6",), ("acs_hosp",), 0.5)


def test_specs_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "datasets.yaml"
    path.write_text(
        "settings: {add_missing_indicators: true, missing_threshold: 0.4}\n"
        "datasets:\n  a: {window: W6T, outcome: acs_hosp, cohort_type: admitted}\n"
        "phenotypes:\n  b: {windows: [W6, W24], outcomes: [death_hosp, acs_hosp]}\n"
    )
    specs = P.load_specs(str(path))
    assert (specs["a"].windows, specs["a"].missing_threshold) == (("W6T",), 0.4)
    assert (specs["b"].windows, specs["b"].outcomes, specs["b"].cohort) == (("W6", "W24"), ("death_hosp", "acs_hosp"), "all")


def test_names():
    assert D.dataset_name(["W6", "W24"], ["a", "b"], "all") == "ed_w6_w24_a_b_all"
    assert D.dataset_name(["W6"], ["a", "b", "c"], "admitted") == "ed_w6_3outcomes_admitted"
    assert D.matched_columns(["sbp_6h", "age", "x_6h"], ["sbp_24h", "age"]) == [("sbp_6h", "sbp_24h"), ("age", "age")]
    assert infer_event_by_columns([]) == []


def test_align_transfer_and_summary(spark):
    a = spark.createDataFrame([(1, 0.5, 0), (2, None, 1), (3, None, 1)], "stay_id int, x double, y int")
    b = spark.createDataFrame([(2, 1), (3, 0), (4, 1)], "stay_id int, y int")
    left, right = D.align_keys(a, b)
    assert sorted(r.stay_id for r in left.collect()) == sorted(r.stay_id for r in right.collect()) == [2, 3]
    assert sorted((r.stay_id, r.y) for r in D.transfer_label(a, b).collect()) == [(2, 1), (3, 0)]
    got = {r.metric: r.value for r in D.dataset_summary(a).collect()}
    assert got["n_rows"] == 3 and got["n_positive"] == 2 and got["n_negative"] == 1 and got["n_over_half_missing"] == 1
    assert got["n_columns"] == 3 and got["n_columns_int"] == 2


def test_full_run_writes_stages_checks_and_datasets(spark, tmp_path):
    specs = [P.PRESETS["ed_w6_det24_admitted"], P.CONFIGURED["ed_w6_det24_all_truncated"], P.PHENOTYPES["cardiac_high_risk"]]
    specs.append(D.DatasetSpec("both", ("W6", "W6T"), ("deterioration_24h_from_w6",), missing_threshold=None))
    out = run(sources(spark, **ROWS), specs, str(tmp_path), csv=True)
    assert {"cohort", "event_log", "labels", "features", "features_w6t", "ecg_w1", "ecg_w6", "qa_violations", "consistency"} <= set(out)
    df = out["datasets/ed_w6_det24_admitted"]
    assert df.count() == 2 and {"ecg_hr_w6", "y", "event_by_deterioration_w6"} <= set(df.columns)
    assert out["datasets/ed_w6_det24_all_truncated"].where("stay_id = 2").first().n_vitalsign_measurements_6h == 2
    both = out["datasets/both"].where("stay_id = 2").first()
    assert both.n_vitalsign_measurements_6h_w6t == 2 <= both.n_vitalsign_measurements_6h_w6 and "features_w6_w6t" in out
    assert (tmp_path / "event_log" / "event_type=ICU_ADMIT").is_dir()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "ed_w6_det24_admitted")).count() == 2
    checks = {r.check_name: r.n for r in out["consistency"].collect()}
    assert checks["base_count"] == checks["outcome_count"] == checks["joined_count"] == 3 and checks["events_before_ed"] == 0


def test_batch_joins_the_stages_once_and_without_broadcasts(stages, monkeypatch):
    src, cohort, labels = stages
    features = X.build_features(cohort, src, [R.W6])
    specs = [D.DatasetSpec(c, ("W6",), ("icu_24h_from_w6",), cohort=c) for c in ("all", "admitted")]
    plans = []
    monkeypatch.setattr(D, "materialize", lambda df, f=D.materialize: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), f(df))[1])
    built = D.assemble_all(cohort, {("W6",): features}, labels, specs)
    assert len(plans) == 1 and plans[0].count("strategy=merge") >= 2
    for spec in specs:
        alone = D.assemble(cohort, features, labels, spec)
        assert built[spec.name].columns == alone.columns
        assert sorted(map(str, built[spec.name].collect())) == sorted(map(str, alone.collect()))
        assert "Join" not in built[spec.name]._jdf.queryExecution().optimizedPlan().toString()
