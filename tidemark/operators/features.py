"""Feature baskets on closed windows [t_in, min(t_out, t_in + P)]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.matching import any_keyword, first_class
from tidemark.functions.ordered import RangeCount, range_counts
from tidemark.functions.timeops import add_hours, hours_between, window_end

_VITAL_FIELDS = ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp")
_DEMOGRAPHICS = ("age_at_ed", "gender", "arrival_transport", "race")
# Never suffixed when several windows are combined.
BASE_COLUMNS = ("stay_id", "subject_id", "hadm_id", "ed_intime", "ed_outtime", "age_at_ed", "gender", "ed_los_hours")


def _end(spec: R.WindowSpec) -> str:
    return f"_end_{spec.name}"


def with_window_ends(cohort: DataFrame, specs: Sequence[R.WindowSpec]) -> DataFrame:
    """Anchors with one closed window end per spec."""
    ends = {_end(s): window_end("ed_intime", "ed_outtime", s.hours) for s in specs}
    return cohort.withColumns(ends)


def truncated_ends(
    cohort: DataFrame, labels: DataFrame, specs: Sequence[R.WindowSpec], clamp: bool = True
) -> DataFrame:
    """Window ends cut off at the first deterioration; anchors without labels drop out.

    ``clamp=False`` lets a window run past departure, as the historic truncated
    tables do.
    """
    event = add_hours("ed_intime", F.col("time_to_deterioration"))
    joined = cohort.join(labels.select("stay_id", "time_to_deterioration"), "stay_id")
    ends = {}
    for s in specs:
        limit = window_end("ed_intime", "ed_outtime", s.hours) if clamp else add_hours("ed_intime", s.hours)
        ends[_end(s)] = F.least(limit, event)  # least skips a NULL event time
    return joined.withColumns(ends).drop("time_to_deterioration")


def mixed_ends(cohort: DataFrame, labels: DataFrame, specs: Sequence[R.WindowSpec], clamp: bool = True) -> DataFrame:
    """Window ends of whole and truncated specs side by side, so that one pass over the streams serves them all."""
    cut = truncated_ends(cohort, labels, [s for s in specs if s.truncated], clamp)
    return with_window_ends(cut, [s for s in specs if not s.truncated])


def _in_windows(anchors: DataFrame, facts: DataFrame, key: str, specs: Sequence[R.WindowSpec]) -> DataFrame:
    """Facts joined once to the widest window; each basket filters by its own end."""
    ends = [_end(s) for s in specs]
    a = anchors.where(F.col(key).isNotNull()).select(*dict.fromkeys(["stay_id", key, "ed_intime", *ends]))
    last = F.greatest(*ends) if len(ends) > 1 else F.col(ends[0])
    return facts.join(a, key).where(F.col("charttime").between(F.col("ed_intime"), last))


def _inside(spec: R.WindowSpec) -> Column:
    return F.col("charttime") <= F.col(_end(spec))


def _in_range(spec: R.WindowSpec, short: str) -> Column:
    """Value of a vital, NULL where an optional plausibility range excludes it."""
    c = F.col(R.VITAL_COLUMNS[short])
    for name, lo, hi in spec.ranges:
        if name == short:
            c = F.when(c.between(lo, hi), c)
    return c


_STATS = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}


def vitals_summary(anchors: DataFrame, vitals: DataFrame, specs: Sequence[R.WindowSpec]) -> DataFrame:
    """Per stay: statistics, counts and first charted row, all windows in one pass."""
    aggs = []
    for s in specs:
        inside = _inside(s)
        if s.first_vitals:
            # The struct orders by time, then by value, so ties are settled.
            row = F.struct("charttime", *_VITAL_FIELDS)
            aggs.append(F.min(F.when(inside, row)).alias(f"_fv_{s.name}"))
        for short, stats in s.vitals:
            value = F.when(inside, _in_range(s, short))
            aggs += [_STATS[st](value).alias(f"{short}_{st}_{s.suffix}") for st in stats]
        if s.vitals:
            aggs.append(F.count_if(inside).alias(f"n_vitalsign_measurements_{s.suffix}"))
        for short in dict.fromkeys((*s.last_vitals, *s.delta_vitals)):
            v = _in_range(s, short)
            known = inside & v.isNotNull()
            point = F.struct(F.col("charttime").alias("t"), v.alias("v"))
            aggs.append(F.max(F.when(known, point)).alias(f"_last_{short}_{s.suffix}"))
            aggs.append(F.min(F.when(known, point)).alias(f"_first_{short}_{s.suffix}"))
        if s.time_to_first_vital:
            aggs.append(F.min(F.when(inside, hours_between("ed_intime", "charttime"))).alias(
                f"time_to_first_vital_{s.suffix}"))
    out = _in_windows(anchors, vitals, "stay_id", specs).groupBy("stay_id").agg(*aggs)
    for s in specs:
        for short in s.last_vitals:
            out = out.withColumn(f"{short}_last_{s.suffix}", F.col(f"_last_{short}_{s.suffix}.v"))
        for short in s.delta_vitals:
            out = out.withColumn(
                f"delta_{short}_{s.suffix}",
                F.col(f"_last_{short}_{s.suffix}.v") - F.col(f"_first_{short}_{s.suffix}.v"),
            )
    hidden = [c for c in out.columns if c.startswith(("_last_", "_first_"))]
    return out.drop(*hidden)


def lab_items(
    dictionary: DataFrame,
    classes: Sequence[tuple[str, Sequence[str]]] = R.LAB_CLASSES,
    hs_items: Sequence[int] = R.HIGH_SENSITIVITY_ITEMS,
) -> DataFrame:
    """Dictionary rows with their lab class (first matching rule) and assay flag."""
    words = [w for _, ws in classes for w in ws]
    return dictionary.where(any_keyword(F.col("label"), words)).select(
        "itemid",
        first_class(F.col("label"), classes).alias("lab_type"),
        F.col("itemid").isin(list(hs_items)).cast("int").alias("is_hs_troponin"),
    )


def classified_labs(labs: DataFrame, items: DataFrame) -> DataFrame:
    """Positive lab values with their class."""
    return (
        labs.where(F.col("valuenum").isNotNull() & (F.col("valuenum") > 0) & F.col("hadm_id").isNotNull())
        .select("hadm_id", "itemid", "charttime", "valuenum")
        .join(items, "itemid")
        .select("hadm_id", "charttime", "lab_type", "valuenum", "is_hs_troponin")
    )


def _first_value_columns(spec: R.WindowSpec, pick) -> list[Column]:
    out = []
    for lab in spec.labs_first:
        out.append(pick(lab)["valuenum"].alias(f"{lab}_first_{spec.suffix}"))
        if lab == "troponin":
            out.append(pick(lab)["is_hs_troponin"].alias(f"is_hs_troponin_{spec.suffix}"))
    return out


_LAB_POINT = ("charttime", "valuenum", "is_hs_troponin")


def labs_summary(anchors: DataFrame, labs: DataFrame, specs: Sequence[R.WindowSpec]) -> DataFrame:
    """Per stay: first value per class ranked inside the window, maxima, time of the first lab."""
    point = F.struct(*_LAB_POINT)
    aggs = []
    for s in specs:
        inside = _inside(s)
        for lab in s.labs_first:
            aggs.append(F.min(F.when(inside & (F.col("lab_type") == lab), point)).alias(f"_{s.name}_{lab}"))
        for lab in s.labs_max:
            aggs.append(F.max(F.when(inside & (F.col("lab_type") == lab), F.col("valuenum"))).alias(f"{lab}_max_{s.suffix}"))
        # only the classes of this basket count towards its first lab
        own = inside & F.col("lab_type").isin(list(s.labs_first))
        aggs.append(F.min(F.when(own, hours_between("ed_intime", "charttime"))).alias(f"_first_lab_{s.name}"))
    wide = _in_windows(anchors, labs, "hadm_id", specs).groupBy("stay_id").agg(*aggs)
    out = []
    for s in specs:
        out += _first_value_columns(s, lambda lab, s=s: F.col(f"_{s.name}_{lab}"))
        out += [F.col(f"{lab}_max_{s.suffix}") for lab in s.labs_max]
        out.append(F.col(f"_first_lab_{s.name}"))
    return wide.select("stay_id", *out)


def labs_summary_by_admission(anchors: DataFrame, labs: DataFrame, spec: R.WindowSpec) -> DataFrame:
    """As ``labs_summary``, but "first" means first of the whole admission.

    When the admission's first value of a class lies outside the window the
    feature is NULL. This is how the historic truncated tables rank.
    """
    kept = labs.where(F.col("lab_type").isin(list(spec.labs_first)))
    firsts = kept.groupBy("hadm_id").agg(
        *[F.min(F.when(F.col("lab_type") == lab, F.struct(*_LAB_POINT))).alias(f"_{lab}") for lab in spec.labs_first]
    )
    a = anchors.where(F.col("hadm_id").isNotNull()).select("stay_id", "hadm_id", "ed_intime", _end(spec))
    seen = lambda lab: F.when(
        F.col(f"_{lab}.charttime").between(F.col("ed_intime"), F.col(_end(spec))), F.col(f"_{lab}")
    )
    first_values = a.join(firsts, "hadm_id").select("stay_id", *_first_value_columns(spec, seen))
    rest = _in_windows(anchors, kept, "hadm_id", [spec]).groupBy("stay_id").agg(
        *[F.max(F.when(F.col("lab_type") == lab, F.col("valuenum"))).alias(f"{lab}_max_{spec.suffix}")
          for lab in spec.labs_max],
        F.min(hours_between("ed_intime", "charttime")).alias(f"_first_lab_{spec.name}"),
    )
    return first_values.join(rest, "stay_id", "left")


def medication_times(anchors: DataFrame, medications: DataFrame, specs: Sequence[R.WindowSpec]) -> DataFrame:
    """Hours from arrival to the first dispensed medication, per window."""
    joined = _in_windows(anchors, medications.select("stay_id", "charttime"), "stay_id", specs)
    return joined.groupBy("stay_id").agg(
        *[F.min(F.when(_inside(s), hours_between("ed_intime", "charttime"))).alias(f"_first_med_{s.name}") for s in specs]
    )


def prior_history(cohort: DataFrame, admissions: DataFrame, stays: DataFrame, lookback: str = "1 YEAR") -> DataFrame:
    """Earlier admissions and visits of the subject on [t_in - lookback, t_in).

    Visits come from all stays, not only the cohort. The anchor's own admission
    does not count; an anchor without admission has no prior admissions by
    definition of the comparison. Rows without an id do not count, and an id counts
    once, also where it occurs with several times: ids with one time go through the linear scan, the few with
    several through a join that counts distinct ids.
    """
    lo, hi = F.col("ed_intime") - F.expr(f"INTERVAL {lookback}"), F.col("ed_intime")
    once, several = {}, {}
    for name, (df, key, time) in {"admissions": (admissions, "hadm_id", "admittime"), "visits": (stays, "stay_id", "intime")}.items():
        times = df.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy("subject_id", F.col(key).alias("_id")).agg(F.collect_set(time).alias("_times"))
        once[name] = (times.where(F.size("_times") == 1).select("subject_id", F.col("_times")[0].alias("_time")), "_time")
        several[name] = times.where(F.size("_times") > 1)
    counted = range_counts(
        cohort, "stay_id", "subject_id", once, {"n_admits": RangeCount("admissions", lo, hi), "n_visits": RangeCount("visits", lo, hi)},
    )
    anchors = cohort.select("stay_id", "subject_id", "hadm_id", "ed_intime")
    inside = F.exists("_times", lambda t: (t >= lo) & (t < hi))
    for name, out in (("admissions", "_more_admits"), ("visits", "_more_visits")):
        more = anchors.join(several[name], "subject_id").where(inside).groupBy("stay_id").agg(F.count_distinct("_id").alias(out))
        counted = counted.join(more, "stay_id", "left").fillna(0, [out])
    own = admissions.groupBy("subject_id", "hadm_id").agg(F.collect_set("admittime").alias("_times"))
    own_inside = F.coalesce(inside.cast("int"), F.lit(0))
    return (
        anchors.join(own, ["subject_id", "hadm_id"], "left")
        .join(counted, "stay_id")
        .select(
            "stay_id",
            F.when(F.col("hadm_id").isNull(), F.lit(0)).otherwise(F.col("n_admits") + F.col("_more_admits") - own_inside)
            .cast("long").alias("prev_admits_1yr"),
            (F.col("n_visits") + F.col("_more_visits")).alias("prev_ed_visits_1yr"),
        )
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den where the denominator is positive, else NULL."""
    return F.when(den > 0, num / den)


def _first_hour_columns(s: R.WindowSpec) -> dict[str, Column]:
    """Triage value, else first charted value; flags and two derived vitals."""
    fv = lambda field: F.col(f"_fv_{s.name}.{field}")
    pick = {short: F.coalesce(F.col(f"_tr_{field}"), fv(field)) for short, field in R.VITAL_COLUMNS.items()}
    w = s.suffix
    cols = {"chiefcomplaint": F.col("_tr_chiefcomplaint")}
    cols |= {f"{short}_{w}": pick[short] for short in ("temp", "hr", "rr", "spo2", "sbp", "dbp")}
    cols |= {"triage_pain": F.col("_tr_pain"), "triage_acuity": F.col("_tr_acuity")}
    cols |= {
        f"shock_index_{w}": ratio(pick["hr"], pick["sbp"]),
        f"map_{w}": (pick["sbp"] + 2 * pick["dbp"]) / 3,
    }
    cols |= {f"missing_{short}_{w}": pick[short].isNull().cast("int") for short in ("temp", "hr", "sbp")}
    return cols


def _summary_columns(s: R.WindowSpec) -> dict[str, Column]:
    w = s.suffix
    cols = {f"{short}_{st}_{w}": F.col(f"{short}_{st}_{w}") for short, stats in s.vitals for st in stats}
    n = f"n_vitalsign_measurements_{w}"
    if s.vitals:
        cols[n] = F.coalesce(F.col(n), F.lit(0))
    cols["chiefcomplaint"] = F.col("_tr_chiefcomplaint")
    for lab in s.labs_first:
        cols[f"{lab}_first_{w}"] = F.col(f"{lab}_first_{w}")
        if lab == "troponin":
            cols[f"is_hs_troponin_{w}"] = F.col(f"is_hs_troponin_{w}")
    cols |= {f"{lab}_max_{w}": F.col(f"{lab}_max_{w}") for lab in s.labs_max}
    if s.process:
        cols["ed_los_hours"] = F.col("ed_los_hours")
        if s.labs_first:
            cols["time_to_first_lab_hours"] = F.col(f"_first_lab_{s.name}")
        cols["time_to_first_med_hours"] = F.col(f"_first_med_{s.name}")
    if s.history:
        cols |= {c: F.col(c) for c in ("prev_admits_1yr", "prev_ed_visits_1yr")}
    if s.trend:
        cols[f"sbp_cv_{w}"] = F.when(F.col(f"sbp_max_{w}") > 0, F.try_divide(f"sbp_std_{w}", f"sbp_mean_{w}"))
        cols[f"hr_range_{w}"] = F.col(f"hr_max_{w}") - F.col(f"hr_min_{w}")
    if s.lab_derived:
        cols["bun_creatinine_ratio"] = ratio(F.col(f"bun_first_{w}"), F.col(f"creatinine_first_{w}"))
        cols[f"lactate_delta_{w}"] = F.col(f"lactate_max_{w}") - F.col(f"lactate_first_{w}")
    cols |= {f"missing_{lab}_{w}": F.col(f"{lab}_first_{w}").isNull().cast("int") for lab in s.lab_missing}
    for short in s.last_vitals:
        cols[f"{short}_last_{w}"] = F.col(f"{short}_last_{w}")
    for short in s.delta_vitals:
        cols[f"delta_{short}_{w}"] = F.col(f"delta_{short}_{w}")
    if s.time_to_first_vital:
        cols[f"time_to_first_vital_{w}"] = F.col(f"time_to_first_vital_{w}")
    return cols


def basket_columns(spec: R.WindowSpec) -> list[str]:
    """Column contract of one basket, in order."""
    return ["stay_id", *_DEMOGRAPHICS, *_columns_of(spec)]


def build_features(
    cohort: DataFrame,
    src,
    specs: Sequence[R.WindowSpec],
    ends: DataFrame | None = None,
    rank_by_admission: bool = False,
    hs_items: Sequence[int] = R.HIGH_SENSITIVITY_ITEMS,
) -> DataFrame:
    """One row per anchor with the baskets of all ``specs``.

    Every stream is read and joined once, at the widest window. With a single
    spec the columns carry their plain names; with several, base columns appear
    once and names that occur in more than one basket get the window's name as
    suffix. ``ends`` (from ``truncated_ends`` or ``mixed_ends``) replaces the default window ends.
    """
    anchors = with_window_ends(cohort, specs) if ends is None else ends
    wide = anchors
    charted = [s for s in specs if s.first_vitals or s.vitals]
    if charted:
        wide = wide.join(vitals_summary(anchors, src.vitals, charted), "stay_id", "left")
    triage = src.triage.select("stay_id", *[F.col(c).alias(f"_tr_{c}") for c in src.triage.columns if c != "stay_id"])
    wide = wide.join(triage, "stay_id", "left")
    with_labs = [s for s in specs if s.labs_first]
    if with_labs:
        # the narrowest class list that still serves every basket
        wanted = {lab for s in with_labs for lab in s.labs_first}
        classes = [c for c in R.LAB_CLASSES if c[0] in wanted]
        labs = classified_labs(src.labs, lab_items(src.lab_items, classes, hs_items))
        if rank_by_admission:
            for s in with_labs:
                wide = wide.join(labs_summary_by_admission(anchors, labs, s), "stay_id", "left")
        else:
            wide = wide.join(labs_summary(anchors, labs, with_labs), "stay_id", "left")
    timed = [s for s in specs if s.process]
    if timed:
        wide = wide.join(medication_times(anchors, src.medications, timed), "stay_id", "left")
    if any(s.history for s in specs):
        wide = wide.join(prior_history(cohort, src.admissions, src.stays), "stay_id", "left")

    demographics = {c: F.col(c) for c in _DEMOGRAPHICS}
    names = wide_names(specs)
    out: dict[str, Column] = {}
    for s in specs:
        for plain, expr in {**demographics, **_columns_of(s)}.items():
            out.setdefault(names[s.name][plain], expr)
    return wide.select("stay_id", *[e.alias(n) for n, e in out.items()])


def _columns_of(spec: R.WindowSpec) -> dict[str, Column]:
    columns = _first_hour_columns(spec) if spec.first_vitals else _summary_columns(spec)
    own = f"_{spec.suffix}"
    plain = lambda c: f"{c.removesuffix(own)}_{spec.shown}" if spec.shown and c.endswith(own) else c
    return {plain(c): e for c, e in columns.items()}


def wide_names(specs: Sequence[R.WindowSpec]) -> dict[str, dict[str, str]]:
    """Per window, plain column name -> its name in a frame that holds all of ``specs``."""
    contracts = {s.name: basket_columns(s)[1:] for s in specs}
    uses: dict[str, int] = {}
    for cols in contracts.values():
        for c in cols:
            uses[c] = uses.get(c, 0) + 1
    keep = lambda c: c in BASE_COLUMNS or uses[c] == 1
    return {w: {c: c if keep(c) else f"{c}_{w}" for c in cols} for w, cols in contracts.items()}


def baskets_from(wide: DataFrame, specs: Sequence[R.WindowSpec], wanted: Sequence[R.WindowSpec]) -> DataFrame:
    """The baskets of ``wanted`` out of a frame built for ``specs``, named as if built alone."""
    stored, target = wide_names(specs), wide_names(wanted)
    picked: dict[str, Column] = {}
    for s in wanted:
        for plain, name in target[s.name].items():
            picked.setdefault(name, F.col(stored[s.name][plain]))
    return wide.select("stay_id", *[e.alias(n) for n, e in picked.items()])


def shock_index_from_means(features: DataFrame, suffix: str = "6h") -> DataFrame:
    """Add-on column: mean heart rate over mean systolic pressure."""
    return features.withColumn(
        f"shock_index_{suffix}", ratio(F.col(f"hr_mean_{suffix}"), F.col(f"sbp_mean_{suffix}"))
    )


def null_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs per column in one row."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


_NO_INDICATOR = ("stay_id", "subject_id", "hadm_id", "ed_intime", "ed_outtime", "y", "gender")


def add_missing_indicators(
    df: DataFrame, threshold: float = 0.30, exclude: Sequence[str] | None = None
) -> DataFrame:
    """Add ``missing_<col>`` for columns with at least ``threshold`` NULLs.

    Which columns qualify decides the schema, so one aggregate row is read back
    to the driver; the rows themselves stay where they are.
    """
    skip = set(_NO_INDICATOR if exclude is None else exclude)
    candidates = [c for c in df.columns if c not in skip and "missing" not in c.lower()]
    if not candidates:
        return df
    fractions = null_fractions(df, candidates).first().asDict()
    chosen = [
        c for c in candidates
        if fractions[c] is not None and fractions[c] >= threshold and f"missing_{c}" not in df.columns
    ]
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"missing_{c}") for c in chosen])
