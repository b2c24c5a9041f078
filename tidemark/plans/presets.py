"""Dataset registries. Names, windows, outcomes and cohorts of known datasets."""

from __future__ import annotations

from tidemark.operators.dataset import DatasetSpec


def _spec(name, windows, outcomes, cohort, ecg=False, threshold=0.30) -> DatasetSpec:
    as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return DatasetSpec(name, as_tuple(windows), as_tuple(outcomes), cohort, ecg, missing_threshold=threshold)


def _registry(rows, threshold) -> dict[str, DatasetSpec]:
    return {r[0]: _spec(*r, threshold=threshold) for r in rows}


DET24 = {w: f"deterioration_24h_from_{w.lower()}" for w in ("W1", "W6", "W24")}

PRESETS = _registry(
    [
        ("ed_w1_det24_all", "W1", DET24["W1"], "all", False),
        ("ed_w6_det24_all", "W6", DET24["W6"], "all", False),
        ("ed_w24_det24_all", "W24", DET24["W24"], "all", False),
        ("ed_w6_det24_admitted", "W6", DET24["W6"], "admitted", True),
        ("ed_w1_det24_admitted", "W1", DET24["W1"], "admitted", True),
        ("ed_w6_coronary_hosp_admitted", "W6", "coronary_event_hosp", "admitted", True),
        ("ed_w6_revasc_hosp_admitted", "W6", "revasc_hosp", "admitted", True),
        ("ed_w6_icu24_admitted", "W6", "icu_24h_from_w6", "admitted", False),
        ("ed_w6_death24_admitted", "W6", "death_24h_from_w6", "admitted", False),
        ("ed_w6_vent24_admitted", "W6", "vent_24h_from_w6", "admitted", False),
        ("ed_w6_pressor24_admitted", "W6", "pressor_24h_from_w6", "admitted", False),
        ("ed_w6_cardiac_arrest_admitted", "W6", "cardiac_arrest_hosp", "admitted", False),
        ("ed_w6_cardiac_arrest_ecg_admitted", "W6", "cardiac_arrest_hosp", "admitted", True),
        ("ed_w6_acs_admitted", "W6", "acs_hosp", "admitted", False),
        ("ed_w6_acs_ecg_admitted", "W6", "acs_hosp", "admitted", True),
        ("ed_w6_det24_no_ecg", "W6", DET24["W6"], "admitted", False),
        ("ed_w24_det48_admitted", "W24", "deterioration_48h_from_w24", "admitted", False),
    ],
    0.30,
)

CONFIGURED = _registry(
    [
        ("ed_w1_icu24_all", "W1", "icu_24h_from_w1", "all"),
        ("ed_w6_det24_all", "W6", DET24["W6"], "all"),
        ("ed_w24_det48_all", "W24", "deterioration_48h_from_w24", "all"),
        ("ed_w1_det24_all", "W1", DET24["W1"], "all"),
        ("ed_w24_det24_all", "W24", DET24["W24"], "all"),
        ("ed_w6_det24_all_truncated", "W6T", DET24["W6"], "all"),
        ("ed_w24_det48_all_truncated", "W24T", "deterioration_48h_from_w24", "all"),
        ("ed_w1_icu24_admitted", "W1", "icu_24h_from_w1", "admitted"),
        ("ed_w6_det24_admitted", "W6", DET24["W6"], "admitted"),
        ("ed_w24_det48_admitted", "W24", "deterioration_48h_from_w24", "admitted"),
        ("ed_w6_cardiac_arrest_admitted", "W6", "cardiac_arrest_hosp", "admitted"),
        ("ed_w24_mortality_48h_admitted", "W24", "death_48h_from_w24", "admitted"),
        ("ed_w6_mortality_24h_all", "W6", "death_24h_from_w6", "all"),
        ("ed_w6_pressor_24h_admitted", "W6", "pressor_24h_from_w6", "admitted"),
        ("ed_w6_vent_24h_admitted", "W6", "vent_24h_from_w6", "admitted"),
        ("ed_w24_rrt_24h_admitted", "W24", "rrt_24h_from_w24", "admitted"),
    ],
    0.50,
)

PHENOTYPES = _registry(
    [
        ("cardiac_high_risk", ("W6", "W24"), ("cardiac_arrest_hosp", "death_24h_from_w6"), "admitted"),
        ("mortality_all_windows", ("W6", "W24"), ("death_24h_from_w6", "death_48h_from_w24", "death_hosp"), "all"),
    ],
    0.50,
)

EXPERIMENTS = _registry(
    [
        ("ed_w1_det24_all", "W1", DET24["W1"], "all", False),
        ("ed_w6_det24_all", "W6", DET24["W6"], "all", False),
        ("ed_w24_det24_all", "W24", DET24["W24"], "all", False),
        ("ed_w6_icu24_admitted", "W6", "icu_24h_from_w6", "admitted", False),
        ("ed_w6_death24_admitted", "W6", "death_24h_from_w6", "admitted", False),
        ("ed_w6_vent24_admitted", "W6", "vent_24h_from_w6", "admitted", False),
        ("ed_w6_pressor24_admitted", "W6", "pressor_24h_from_w6", "admitted", False),
        ("ed_w6_cardiac_arrest_admitted", "W6", "cardiac_arrest_hosp", "admitted", False),
        ("ed_w6_acs_admitted", "W6", "acs_hosp", "admitted", False),
        ("ed_w6_cardiac_arrest_ecg_admitted", "W6", "cardiac_arrest_hosp", "admitted", True),
        ("ed_w6_acs_ecg_admitted", "W6", "acs_hosp", "admitted", True),
        ("ed_w6_det24_all_ecg", "W6", DET24["W6"], "all", True),
        ("ed_w6_det24_admitted_ecg", "W6", DET24["W6"], "admitted", True),
    ],
    0.50,
)


def spec_from_dict(name: str, entry: dict, threshold: float = 0.50) -> DatasetSpec:
    """Spec of one configuration entry (``window``/``windows``, ``outcome``/``outcomes``)."""
    windows = entry.get("windows", entry.get("window"))
    outcomes = entry.get("outcomes", entry.get("outcome"))
    as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return DatasetSpec(
        name, as_tuple(windows), as_tuple(outcomes), entry.get("cohort_type", "all"),
        entry.get("include_ecg", False), entry.get("filter", ""),
        missing_threshold=threshold, description=entry.get("description", ""),
    )


def load_specs(path: str) -> dict[str, DatasetSpec]:
    """Specs of a YAML file with ``settings``, ``datasets`` and ``phenotypes``."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML specs needs the yaml package") from e
    with open(path) as f:
        config = yaml.safe_load(f)
    settings = config.get("settings", {})
    threshold = settings.get("missing_threshold", 0.50) if settings.get("add_missing_indicators", True) else None
    entries = {**config.get("datasets", {}), **config.get("phenotypes", {})}
    return {name: spec_from_dict(name, e, threshold) for name, e in entries.items()}
