"""Datasets: base columns, features, optional ECG, outcome(s), already-happened flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.reshape import long_form
from tidemark.functions.session import materialize
from tidemark.operators.cohort import PRESETS, select_cohort
from tidemark.operators.features import BASE_COLUMNS, add_missing_indicators
from tidemark.operators.labels import infer_event_by_columns

FEATURE_WINDOWS = ("W1", "W6", "W24", "W6T", "W24T")
ECG_WINDOWS = ("W1", "W6")


@dataclass(frozen=True)
class DatasetSpec:
    """What a dataset contains. ``missing_threshold=None`` adds no indicators."""

    name: str
    windows: tuple[str, ...]
    outcomes: tuple[str, ...]
    cohort: str = "all"
    include_ecg: bool = False
    where: str = ""
    include_base: bool = True
    missing_threshold: float | None = 0.30
    description: str = ""

    def __post_init__(self):
        if not self.windows or not self.outcomes:
            raise ValueError(f"{self.name}: needs at least one window and one outcome")
        if bad := [w for w in self.windows if w not in FEATURE_WINDOWS]:
            raise ValueError(f"{self.name}: unknown windows {bad}")
        if self.cohort not in PRESETS:
            raise ValueError(f"{self.name}: unknown cohort {self.cohort}")

    def check_outcomes(self, labels: DataFrame) -> None:
        if bad := [o for o in self.outcomes if o not in labels.columns]:
            raise ValueError(f"{self.name}: unknown outcomes {bad}")


def dataset_name(windows: Sequence[str], outcomes: Sequence[str], cohort: str) -> str:
    outcome = "_".join(outcomes) if len(outcomes) <= 2 else f"{len(outcomes)}outcomes"
    return f"ed_{'_'.join(w.lower() for w in windows)}_{outcome}_{cohort}"


def outcome_names(spec: DatasetSpec) -> dict[str, str]:
    """Label column -> column name in the dataset."""
    if len(spec.outcomes) == 1:
        return {spec.outcomes[0]: "y"}
    return {o: f"y_{o}" for o in spec.outcomes}


def join_stages(cohort: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Cohort, features and labels on the stay; a column of the cohort wins over the same name in the features."""
    extra = [c for c in features.columns if c not in cohort.columns]
    joined = cohort.join(features.select("stay_id", *extra), "stay_id")
    label_cols = [c for c in labels.columns if c not in joined.columns]
    return joined.join(labels.select("stay_id", *label_cols), "stay_id")


def assemble(
    cohort: DataFrame,
    features: DataFrame,
    labels: DataFrame,
    spec: DatasetSpec,
    ecg: Mapping[str, DataFrame] | None = None,
    joined: DataFrame | None = None,
) -> DataFrame:
    """Join the stage tables on the stay and select the columns of ``spec``.

    ``features`` holds the baskets of ``spec.windows`` (see ``build_features``),
    ``ecg`` the ECG features per window, ``joined`` the result of ``join_stages``
    where it is already there.
    """
    spec.check_outcomes(labels)
    own = [c for c in features.columns if c not in BASE_COLUMNS]
    ecg_frames = [(ecg or {})[w] for w in spec.windows if w in ECG_WINDOWS] if spec.include_ecg else []
    joined = join_stages(cohort, features, labels) if joined is None else joined
    for frame in ecg_frames:
        joined = joined.join(frame, "stay_id", "left")
    kept = select_cohort(joined, spec.cohort, spec.where)

    base = list(BASE_COLUMNS) if spec.include_base else ["stay_id"]
    plain = [c for c in features.columns if c != "stay_id"] if not spec.include_base else own
    ecg_cols = [c for frame in ecg_frames for c in frame.columns if c != "stay_id"]
    y = outcome_names(spec)
    out = kept.select(
        *base, *plain, *ecg_cols,
        *[F.col(o).alias(n) for o, n in y.items()],
        *infer_event_by_columns(spec.outcomes),
    )
    if spec.missing_threshold is None:
        return out
    skip = ["stay_id", "subject_id", "hadm_id", "ed_intime", "ed_outtime", "gender", *y.values()]
    return add_missing_indicators(out, spec.missing_threshold, skip)


def assemble_all(cohort, features: Mapping[tuple[str, ...], DataFrame], labels, specs, ecg=None) -> dict[str, DataFrame]:
    """Every spec of a list; a spec that cannot be assembled raises.

    The stages are joined once per set of windows, by a shuffle, and written: specs read the result, and
    no copy of a stage table is collected on the driver for each of their passes.
    """
    for s in specs:
        s.check_outcomes(labels)
    joined = {w: materialize(join_stages(cohort, features[w].hint("merge"), labels.hint("merge"))) for w in dict.fromkeys(s.windows for s in specs)}
    return {s.name: assemble(cohort, features[s.windows], labels, s, ecg, joined[s.windows]) for s in specs}


def align_keys(a: DataFrame, b: DataFrame, key: str = "stay_id") -> tuple[DataFrame, DataFrame]:
    """Both datasets reduced to the keys they have in common."""
    return a.join(b.select(key), key, "left_semi"), b.join(a.select(key), key, "left_semi")


def transfer_label(features: DataFrame, labelled: DataFrame, label: str = "y", key: str = "stay_id") -> DataFrame:
    """Features of one dataset with the label of another, on the common keys."""
    return features.drop(label).join(labelled.select(key, label), key)


def matched_columns(columns: Sequence[str], others: Sequence[str], a: str = "_6h", b: str = "_24h") -> list[tuple[str, str]]:
    """Pairs of columns that mean the same in two windows."""
    known = set(others)
    pairs = [(c, c.replace(a, b)) for c in columns]
    return [(c, d) for c, d in pairs if d in known]


def dataset_summary(df: DataFrame, label: str = "y") -> DataFrame:
    """Long (metric, value) summary: shape, outcome counts, columns over half missing, types."""
    others = [c for c in df.columns if c != label]
    missing = F.filter(
        F.array(*[F.avg(F.col(c).isNull().cast("double")) for c in others]), lambda x: x > 0.5
    )
    wide = df.agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"),
        F.sum(label).cast("double").alias("n_positive"),
        F.avg(label).alias("outcome_rate"),
        F.size(missing).cast("double").alias("n_over_half_missing"),
    )
    types: dict[str, int] = {}
    for _, t in df.dtypes:
        types[t] = types.get(t, 0) + 1
    rows = {n: F.col(n) for n in ("n_rows", "n_positive", "outcome_rate", "n_over_half_missing")}
    rows |= {"n_columns": F.lit(float(len(df.columns))), "n_negative": F.col("n_rows") - F.col("n_positive")}
    rows |= {f"n_columns_{t}": F.lit(float(n)) for t, n in types.items()}
    return long_form(wide, {m: {"value": c} for m, c in rows.items()}, "metric")
