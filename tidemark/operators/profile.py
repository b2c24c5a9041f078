"""Column profiles, quality report, cohort tables and subgroup rates.

Distinct counts, quantiles, value counts and IQR outliers all start from one
frequency table (column, value, n). It is built with map-side aggregation and
walked with running counts, so neither a frequent value nor a long tail of
distinct ones has to fit into a single task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import rules as R
from tidemark.functions.ordered import exact_quantiles
from tidemark.functions.reshape import long_form
from tidemark.functions.session import materialize
from tidemark.functions.stats import correlation

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if (t in _NUMERIC or t.startswith("decimal")) and c not in exclude]


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def basic_info(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def frequencies(df: DataFrame, columns: Sequence[str], as_type: str = "double") -> DataFrame:
    """(column_name, value, n) over all given columns in one pass; NULLs are kept.

    Different long integers and decimals that share a double stay different rows.
    """
    types = dict(df.dtypes)
    exact = lambda c: as_type == "double" and (types[c] == "bigint" or types[c].startswith("decimal"))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast(as_type).alias("value"), F.when(F.lit(exact(c)), F.col(c).cast("string")).alias("key"))
        for c in columns
    ])
    return (
        df.select(F.explode(pairs).alias("x"))
        .groupBy(F.col("x.column_name").alias("column_name"), F.col("x.value").alias("value"), F.col("x.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("n")).drop("key")
    )


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}_n"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"),
                 F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std")]
    rows = {
        c: {
            "n_present": F.col(f"{c}_n"),
            "n_missing": F.col("_n") - F.col(f"{c}_n"),
            "pct_missing": 100.0 * F.try_divide(F.col("_n") - F.col(f"{c}_n"), F.col("_n")),
            "min_value": F.col(f"{c}_min"), "max_value": F.col(f"{c}_max"),
            "mean_value": F.col(f"{c}_mean"), "std_value": F.col(f"{c}_std"),
        }
        for c in columns
    }
    return long_form(df.agg(*aggs), rows, "column_name")


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing, min, max, mean and sample deviation of chosen columns."""
    return _moments(df, columns).drop("n_present")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per numeric column: missing, distinct count, moments, quartiles, constant flag.

    ``approx=True`` replaces the exact quartiles and distinct counts by sketches.
    """
    columns = list(columns or numeric_columns(df))
    base = _moments(df, columns)
    if approx:
        aggs = []
        for c in columns:
            x = F.col(c).cast("double")
            aggs += [F.approx_count_distinct(x).alias(f"{c}_u"), F.percentile_approx(x, list(QUARTILES.values())).alias(f"{c}_q")]
        rows = {c: {"n_unique": F.col(f"{c}_u"), **{q: F.col(f"{c}_q")[i] for i, q in enumerate(QUARTILES)}} for c in columns}
        rest = long_form(df.agg(*aggs), rows, "column_name")
    else:
        found = exact_quantiles(frequencies(df, columns), ["column_name"], "value", "n", QUARTILES, sizes=True)
        rest = found.withColumnRenamed("n_distinct", "n_unique").drop("n_values")
    constant = (F.col("min_value") == F.col("max_value")) & (F.col("n_present") > 1)
    return (
        base.join(rest, "column_name", "left").fillna(0, ["n_unique"])
        .withColumn("is_constant", F.coalesce(constant, F.lit(False)).cast("int"))
        .drop("n_present")
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n, n_distinct) of all given columns; pick short ones by ``n_distinct``."""
    freq = frequencies(df, columns, "string").where(F.col("value").isNotNull())
    sizes = freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return freq.join(F.broadcast(sizes), "column_name")  # one row per column of the schema


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells over all columns in one row."""
    cols = df.columns
    counted = df.agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.count_if(F.col(c).isNull()) for c in cols]).alias("_m"))
    total = F.aggregate("_m", F.lit(0).cast("long"), lambda a, x: a + x)
    cells = F.col("_n") * len(cols)
    return counted.select(
        total.alias("total_missing_cells"),
        cells.alias("total_cells"),
        (100.0 * F.try_divide(total, cells)).alias("pct_missing_overall"),
        F.size(F.filter("_m", lambda x: x > 0)).alias("columns_with_missing"),
        F.size(F.filter("_m", lambda x: x == 0)).alias("columns_fully_complete"),
        F.size(F.filter("_m", lambda x: x > 0.5 * F.col("_n"))).alias("columns_over_half_missing"),
    )


def missing_ranking(df: DataFrame, top: int | None = None) -> DataFrame:
    """Columns with missing values, most missing first."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    long = long_form(wide, {c: {"pct_missing": 100.0 * F.col(c)} for c in df.columns}, "column_name")
    ranked = long.where(F.col("pct_missing") > 0).orderBy(F.col("pct_missing").desc(), "column_name")
    return ranked.limit(top) if top else ranked


def outcome_summary(df: DataFrame, label: str = "y") -> DataFrame:
    """Positives, negatives, rate, class balance, and the graded warning on the rate."""
    rate = F.col("outcome_rate")
    return df.agg(
        F.count_if(F.col(label) == 1).alias("n_positive"),
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.avg(F.col(label).cast("double")).alias("outcome_rate"),
    ).select(
        "n_positive", "n_negative", "outcome_rate",
        (2 * F.least(rate, 1 - rate)).alias("class_balance"),
        F.when(rate < 0.01, "very low").when(rate < 0.05, "low").when(rate > 0.5, "high").otherwise("ok").alias("warning"),
    )


def outliers(df: DataFrame, columns: Sequence[str] | None = None, z: float = 3.0, min_rows: int = 10) -> DataFrame:
    """IQR and z-score outlier counts per numeric column.

    Columns with at most two values and indicator columns have none; columns with
    fewer than ``min_rows`` values are marked by ``few_values``.
    """
    columns = list(columns or [c for c in numeric_columns(df) if not c.startswith("missing_")])
    present = materialize(frequencies(df, columns).where(F.col("value").isNotNull()))
    bounds = (
        exact_quantiles(present, ["column_name"], "value", "n", {"q1": 0.25, "q3": 0.75}, sizes=True)
        .join(_moments(df, columns), "column_name")
        .where(F.col("n_distinct") > 2)
        .select(
            "column_name", "n_values",
            (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
            (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"),
            F.col("mean_value").alias("_mean"), F.col("std_value").alias("_std"),
        )
    )
    v = F.col("value")
    # one row per column of the schema, hence small
    joined = present.join(F.broadcast(bounds), "column_name")
    iqr = (v < F.col("lower_bound")) | (v > F.col("upper_bound"))
    zscore = F.abs(v - F.col("_mean")) > z * F.col("_std")
    few = (F.col("n_values") < min_rows).cast("int").alias("few_values")
    return joined.groupBy("column_name", "n_values", "lower_bound", "upper_bound", few).agg(
        F.sum(F.when(iqr, F.col("n")).otherwise(0)).alias("n_outliers_iqr"),
        F.sum(F.when(zscore, F.col("n")).otherwise(0)).alias("n_outliers_zscore"),
    )


def correlations_with(df: DataFrame, label: str, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Pearson correlation with the label, strongest first; NULL pairs are ignored."""
    wide = df.agg(*[correlation(F.col(c), F.col(label)).alias(c) for c in columns])
    long = long_form(wide, {c: {"correlation": F.col(c)} for c in columns}, "column_name")
    ranked = long.where(F.col("correlation").isNotNull()).orderBy(
        F.abs("correlation").desc(), "column_name"
    )
    return ranked.limit(top) if top else ranked


#: sums of squares that differ by less, relative to their size, belong to a column that does not vary
_FLAT = 1e-13


def correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """(feature1, feature2, correlation) of all column pairs in one pass, optionally only strong ones.

    Pearson over complete pairs, NULL where a side does not vary in them, NaN where they hold numbers that are not finite.
    A task adds up masked cross products of its rows, centred on the means of the columns, and gives one row
    per pair; only those meet.
    """
    columns = list(columns)
    numbers = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in numbers.columns]).first()
    centre = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means], float)
    one, two = np.triu_indices(len(columns), 1)
    names = ("n", "x", "y", "xx", "yy", "xy", "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(one)))
        for batch in batches:
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            odd = (~np.isfinite(x)).astype(float)
            x = (np.where(odd > 0, 0.0, x) - centre) * known
            along, squares, strange = x.T @ known, (x * x).T @ known, odd.T @ known
            total += np.stack([(known.T @ known)[one, two], along[one, two], along[two, one], squares[one, two], squares[two, one], (x.T @ x)[one, two],
                               strange[one, two] + strange[two, one]])
        yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), *map(pa.array, total)], names=["i", "j", *names])

    sums = numbers.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} double" for n in names))
    n, x, y, xx, yy, xy, odd = (F.col(c) for c in names)
    varies = lambda square, first: F.when(n * square - first * first > _FLAT * n * square, n * square - first * first)
    name = lambda at: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(at) + 1)
    out = (
        sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
        .withColumn("correlation", F.when(odd > 0, F.lit(float("nan"))).otherwise((n * xy - x * y) / F.sqrt(varies(xx, x) * varies(yy, y))))
        .select(name("i").alias("feature1"), name("j").alias("feature2"), "correlation")
    )
    if threshold is None:
        return out
    return out.where(F.abs("correlation") > threshold).orderBy(F.abs("correlation").desc(), "feature1", "feature2")


def point_biserial(df: DataFrame, label: str, columns: Sequence[str], min_pairs: int = 100) -> DataFrame:
    """Correlation with a 0/1 label, number of pairs, t statistic, and whether there are more than ``min_pairs``."""
    aggs = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(label).isNotNull()
        aggs += [correlation(F.col(c), F.col(label)).alias(f"{c}_r"), F.count_if(both).alias(f"{c}_n")]
    r = lambda c: F.col(f"{c}_r")
    rows = {
        c: {
            "correlation": r(c), "n_pairs": F.col(f"{c}_n"), "enough_pairs": (F.col(f"{c}_n") > min_pairs).cast("int"),
            "t_statistic": r(c) * F.sqrt(F.try_divide(F.col(f"{c}_n") - 2, 1 - r(c) * r(c))),
        }
        for c in columns
    }
    return long_form(df.agg(*aggs), rows, "column_name")


def sanity_checks(
    df: DataFrame, key: str = "stay_id", label: str = "y", age: str = "age_at_ed",
    ranges: Sequence[tuple[str, float, float]] = R.VITAL_RANGES, suffixes: Sequence[str] = ("_1h", "_6h", "_24h", ""),
) -> DataFrame:
    """(check_name, status, value): duplicate keys, outcome rate, ages, vital ranges, empty columns."""
    cols = set(df.columns)
    aggs: dict[str, Column] = {"_n": F.count(F.lit(1))}
    if key in cols:
        aggs["unique_keys"] = F.count(F.lit(1)) - F.count_distinct(key)
    if label in cols:
        aggs["outcome_rate_bounds"] = F.avg(F.col(label).cast("double"))
    if age in cols:
        aggs["age_range"] = F.count_if((F.col(age) < 18) | (F.col(age) > 120))
    in_range = {}
    for stem, lo, hi in ranges:
        for s in suffixes:
            if (c := stem + s) in cols:
                in_range[f"range_{c}"] = F.avg((~F.col(c).between(lo, hi)).cast("double"))
    aggs |= in_range
    aggs["all_null_columns"] = F.size(F.filter(F.array(*[F.count(c) for c in df.columns]), lambda x: x == 0))
    wide = df.agg(*[e.alias(n) for n, e in aggs.items()])
    v = lambda n: F.col(n).cast("double")
    status = {
        "unique_keys": lambda x: F.when(x == 0, "pass").otherwise("warn"),
        "outcome_rate_bounds": lambda x: F.when(x < 0.001, "fail").when((x < 0.01) | (x > 0.5), "warn").otherwise("pass"),
        "age_range": lambda x: F.when(x == 0, "pass").otherwise("warn"),
        "all_null_columns": lambda x: F.when(x == 0, "pass").otherwise("fail"),
    }
    by_range = lambda x: F.when(F.coalesce(x, F.lit(0.0)) > 0.05, "warn").otherwise("pass")
    rows = {n: {"status": status.get(n, by_range)(v(n)), "value": v(n)} for n in aggs if n != "_n"}
    return long_form(wide, rows, "check_name")


def quality_score(pct_missing: Column, n_warnings: Column, n_errors: Column, outcome_rate: Column | None = None) -> Column:
    """100 minus penalties for missing cells (at most 20), warnings, errors and a rare outcome; never below 0."""
    score = F.lit(100.0) - F.least(pct_missing * 0.5, F.lit(20.0)) - n_warnings * 2 - n_errors * 10
    if outcome_rate is not None:
        score -= F.when(outcome_rate < 0.01, 10).when(outcome_rate < 0.05, 5).otherwise(0)
    return F.greatest(F.round(score, 1), F.lit(0.0))


def quality_report(df: DataFrame, label: str = "y", key: str = "stay_id", columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All report tables of a dataset, with the score as last one. The input is written once for all of them."""
    df = materialize(df)
    columns = list(columns or numeric_columns(df, ("stay_id", "subject_id", "hadm_id", label)))
    report = {
        "basic_info": basic_info(df),
        "columns": column_profile(df, columns),
        "value_counts": value_counts(df, string_columns(df) or columns),
        "missing": missing_summary(df),
        "outcome": outcome_summary(df, label),
        "outliers": outliers(df, columns),
        "correlations": correlations_with(df, label, columns),
        "correlated_pairs": correlation_pairs(df, columns, 0.8),
        "sanity": sanity_checks(df, key, label),
    }
    report["score"] = score_report(report)
    return report


def score_report(report: Mapping[str, DataFrame]) -> DataFrame:
    """Quality score from the other report tables: one row."""
    one = F.lit(1).alias("_one")
    sanity = report["sanity"].agg(
        F.count_if((F.col("status") == "warn") & (F.col("check_name") != "outcome_rate_bounds")).alias("_w"),
        F.count_if(F.col("status") == "fail").alias("_e"),
    )
    constant = report["columns"].agg(F.sum("is_constant").alias("_c"))
    pairs = report["correlated_pairs"].agg(F.count(F.lit(1)).alias("_p"))
    wide = report["missing"].select("*", one)
    for part in (report["outcome"], sanity, constant, pairs):
        wide = wide.join(part.select("*", one), "_one")
    n_warnings = (
        F.col("_w") + F.coalesce("_c", F.lit(0))
        + (F.col("columns_over_half_missing") > 0).cast("int") + (F.col("warning") != "ok").cast("int")
        + (F.col("_p") > 5).cast("int")
    )
    return wide.select(
        n_warnings.cast("long").alias("n_warnings"), F.col("_e").alias("n_errors"),
        quality_score(F.col("pct_missing_overall"), n_warnings, F.col("_e"), F.col("outcome_rate")).alias("quality_score"),
    )


def feature_summary(df: DataFrame, label: str | None = "y") -> DataFrame:
    """One row per column: missing, distinct, numeric statistics where at least half parses, top values.

    Text columns count as numeric when half of their non-null values parse.
    """
    strings = set(string_columns(df))
    columns = [c for c, t in df.dtypes if c in strings or c in numeric_columns(df)]
    number = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        x = number[c]
        aggs += [F.count(c).alias(f"{c}_n"), F.count(x).alias(f"{c}_k"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"),
                 F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std")]
        r = correlation(x, F.col(label)) if label and c != label else F.lit(None).cast("double")
        aggs.append(r.alias(f"{c}_r"))
    usable = {c: (F.col(f"{c}_k") > 0) & (F.col(f"{c}_k") >= 0.5 * F.col(f"{c}_n")) for c in columns}
    rows = {
        c: {
            "is_text": F.lit(int(c in strings)),
            "n_missing": F.col("_n") - F.col(f"{c}_n"),
            "pct_missing": 100.0 * F.try_divide(F.col("_n") - F.col(f"{c}_n"), F.col("_n")),
            "is_numeric": usable[c].cast("int"),
            **{f"{s}_value": F.when(usable[c], F.col(f"{c}_{s}")) for s in ("min", "max", "mean", "std")},
            "corr_with_y": F.when(usable[c], F.col(f"{c}_r")),
        }
        for c in columns
    }
    base = long_form(df.agg(*aggs), rows, "column_name")
    freq = frequencies(df, columns, "string").where(F.col("value").isNotNull())
    unique = freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    numeric_freq = (
        freq.withColumn("x", F.expr("try_cast(value AS DOUBLE)")).where(F.col("x").isNotNull())
        .groupBy("column_name", "x").agg(F.sum("n").alias("n"))
    )
    medians = exact_quantiles(numeric_freq, ["column_name"], "x", "n", {"median_value": 0.5})
    # the filter on the rank cuts each task's part to three rows per column before they meet
    ranked = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value"))
    top = (
        freq.where(F.col("column_name").isin(sorted(strings))).withColumn("_rank", ranked).where(F.col("_rank") <= 3)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))).alias("t"))
        .select("column_name", F.array_join(F.transform("t", lambda x: F.concat(x["value"], F.lit("("), -x["m"], F.lit(")"))), "; ").alias("top_values"))
    )
    return (
        base.join(unique, "column_name", "left").fillna(0, ["n_unique"]).join(medians, "column_name", "left")
        .withColumn("median_value", F.when(F.col("is_numeric") == 1, F.col("median_value")))
        .join(top, "column_name", "left")
    )


def cohort_table(cohort: DataFrame, numeric: Sequence[str], flags: Mapping[str, Column], categories: Sequence[str]) -> DataFrame:
    """Descriptive table in long form: (variable, level, n, pct, median, q25, q75)."""
    present = [F.count(c).alias(f"n_{c}") for c in numeric]
    wide = cohort.agg(F.count(F.lit(1)).alias("_n"), *present, *[F.count_if(e).alias(f"f_{n}") for n, e in flags.items()])
    none = F.lit(None).cast("double")
    rows = {
        n: {"level": F.lit("1"), "n": F.col(f"f_{n}"), "pct": 100.0 * F.col(f"f_{n}") / F.col("_n"),
            **{q: none for q in QUARTILES}}
        for n in flags
    }
    flag_rows = long_form(wide, rows, "variable")
    quart = exact_quantiles(frequencies(cohort, numeric), ["column_name"], "value", "n", QUARTILES)
    counts = long_form(wide, {c: {"n": F.col(f"n_{c}"), "pct": 100.0 * F.col(f"n_{c}") / F.col("_n")} for c in numeric}, "column_name")
    num_rows = quart.join(counts, "column_name").select(
        F.col("column_name").alias("variable"), F.lit("median").alias("level"), "n", "pct", *QUARTILES
    )
    total = wide.select("_n", F.lit(1).alias("_one"))
    cat_rows = (
        frequencies(cohort, categories, "string").withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")  # one row
        .select(
            F.col("column_name").alias("variable"), F.coalesce("value", F.lit("(null)")).alias("level"), "n",
            (100.0 * F.col("n") / F.col("_n")).alias("pct"), *[none.alias(q) for q in QUARTILES],
        )
    )
    return flag_rows.unionByName(num_rows).unionByName(cat_rows)


def cohort_descriptives(cohort: DataFrame, labels: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Sizes, age, stay length and outcome rates in one row."""
    return (
        cohort.join(labels.select("stay_id", *outcomes), "stay_id")
        .agg(
            F.count(F.lit(1)).alias("n_stays"), F.count_distinct("subject_id").alias("n_subjects"),
            F.avg("age_at_ed").alias("age_mean"), F.stddev_samp("age_at_ed").alias("age_std"),
            F.avg((F.col("gender") == "M").cast("double")).alias("male_rate"),
            F.avg(F.col("was_admitted").cast("double")).alias("admission_rate"),
            F.avg("ed_los_hours").alias("los_mean"),
            *[F.avg(o).alias(f"rate_{o}") for o in outcomes],
        )
    )


def binned(value: Column, edges: Sequence[float], names: Sequence[str], right: bool = True) -> Column:
    """Name of the bin; ``right`` closes bins on the right, else on the left. NULL outside the edges."""
    out = None
    for lo, hi, name in zip(edges[:-1], edges[1:], names, strict=True):
        hit = (value > lo) & (value <= hi) if right else (value >= lo) & (value < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


AGE_EDGES = (0.0, 30.0, 50.0, 65.0, 80.0, 120.0)
AGE_NAMES = ("18-29", "30-49", "50-64", "65-79", "80+")


def rates_by(df: DataFrame, groups: Mapping[str, Column], rates: Mapping[str, Column], means: Mapping[str, Column] | None = None) -> DataFrame:
    """Group size and the mean of each 0/1 or numeric expression per group."""
    return df.groupBy(*[e.alias(n) for n, e in groups.items()]).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(e.cast("double")).alias(n) for n, e in {**rates, **(means or {})}.items()],
    )


TIME_EDGES = (float("-inf"), 6.0, 12.0, 24.0, 48.0, float("inf"))
TIME_NAMES = ("0-6h", "6-12h", "12-24h", "24-48h", ">48h")


def time_histogram(df: DataFrame, hours: Column, edges: Sequence[float] = TIME_EDGES, names: Sequence[str] = TIME_NAMES) -> DataFrame:
    """Counts per time bucket (closed on the right) in bucket order; NULL times are left out."""
    rank = binned(hours, edges, [str(i) for i in range(len(names))]).cast("int")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("bucket_rank") + 1)
    return (
        df.where(hours.isNotNull()).groupBy(rank.alias("bucket_rank")).agg(F.count(F.lit(1)).alias("n"))
        .select("bucket_rank", label.alias("bucket"), "n").orderBy("bucket_rank")
    )


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; bin 0 and bins+1 hold values outside [lo, hi)."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
