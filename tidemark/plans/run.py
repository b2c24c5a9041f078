"""The whole build: stage tables, checks and datasets under one output folder."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.session import tune
from tidemark.operators.cohort import build_cohort
from tidemark.operators.dataset import ECG_WINDOWS, DatasetSpec, assemble
from tidemark.operators.ecg import build_ecg_features
from tidemark.operators.events import build_event_log
from tidemark.operators.features import baskets_from, build_features, mixed_ends, truncated_ends
from tidemark.operators.labels import build_labels
from tidemark.operators.qa import consistency_checks, ecg_violations, qa_summary, qa_violations, sanity_counts
from tidemark.sources.sinks import write_csv, write_table
from tidemark.sources.tables import Sources


def _truncation_of(window: str) -> R.WindowSpec:
    return R.WINDOWS[window.removesuffix("T")]


def run(
    src: Sources,
    specs: Sequence[DatasetSpec],
    out_dir: str,
    windows: Sequence[str] = ("W1", "W6", "W24"),
    checks: bool = True,
    csv: bool = False,
) -> dict[str, DataFrame]:
    """Build every stage once as Parquet, then each dataset from the stage tables.

    All standard windows come from a single pass over the streams; truncated
    windows are built only when a spec asks for them. Any failing step raises.
    Returns the written tables by name.
    """
    tune(src.stays.sparkSession)
    needed = {w for s in specs for w in s.windows} | set(windows)
    out: dict[str, DataFrame] = {}

    def stage(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        out[name] = write_table(df, f"{out_dir}/{name}", partition_by)
        return out[name]

    cohort = stage("cohort", build_cohort(src.stays, src.persons))
    events = stage("event_log", build_event_log(cohort, src), ["event_type"])
    labels = stage("labels", build_labels(cohort, events))
    standard = [R.WINDOWS[w] for w in R.WINDOWS if w in needed]
    features = stage("features", build_features(cohort, src, standard)) if standard else None
    # truncated windows that a dataset uses alone; with others they come from a pass of their own
    alone = {w for s in specs if len(s.windows) == 1 for w in s.windows} | set(windows)
    for w in sorted((needed & alone) - set(R.WINDOWS)):
        spec = _truncation_of(w)
        ends = truncated_ends(cohort, labels, [spec])
        stage(f"features_{w.lower()}", build_features(cohort, src, [spec], ends=ends))
    ecg = {
        w: stage(f"ecg_{w.lower()}", build_ecg_features(cohort, src.ecg_studies, src.ecg_measurements, R.WINDOWS[w].hours, w.lower()))
        for w in ECG_WINDOWS
        if w in needed
    }

    if checks:
        found = [qa_violations(cohort, events, labels), *[ecg_violations(cohort, g, w.lower()) for w, g in ecg.items()]]
        violations = stage("qa_violations", reduce(DataFrame.unionByName, found))
        failed = qa_summary(violations).where(F.col("severity") == "ERROR")
        if not failed.isEmpty():
            names = ", ".join(f"{r.check_name} ({r.n})" for r in failed.orderBy("check_name").toLocalIterator())
            raise RuntimeError(f"integrity checks failed: {names}")
        stage("sanity_counts", sanity_counts(cohort, events, labels))
        if "W1" in needed:
            first_hour = baskets_from(features, standard, [R.W1])
            stage("consistency", consistency_checks(cohort, events, labels, first_hour))

    def mixed(names: Sequence[str]) -> DataFrame:
        """Whole and truncated windows from one pass over the streams, built once per combination."""
        name = f"features_{'_'.join(names).lower()}"
        if name not in out:
            wanted = [R.WINDOWS[w] if w in R.WINDOWS else R.truncated_window(_truncation_of(w)) for w in names]
            stage(name, build_features(cohort, src, wanted, ends=mixed_ends(cohort, labels, wanted)))
        return out[name]

    for spec in specs:
        own = [R.WINDOWS[w] for w in spec.windows if w in R.WINDOWS]
        cut = [w for w in spec.windows if w not in R.WINDOWS]
        if cut and len(spec.windows) > 1:
            frame = mixed(spec.windows)
        else:
            frame = out[f"features_{cut[0].lower()}"] if cut else baskets_from(features, standard, own)
        data = stage(f"datasets/{spec.name}", assemble(cohort, frame, labels, spec, ecg))
        if csv:
            write_csv(data, f"{out_dir}/csv/{spec.name}")
    return out
