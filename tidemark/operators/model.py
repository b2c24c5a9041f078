"""Model data preparation and experiments on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.ordered import positions, running
from tidemark.functions.session import materialize
from tidemark.operators.boosting import TABLE_LEVEL, fit_blocks
from tidemark.operators.boosting_grid import fit_grid
from tidemark.operators.evaluate import fold_summary, group_fold, ranking_metrics, shuffled_labels, stratified_folds, threshold_metrics
from tidemark.operators.forest import fit_forest
from tidemark.operators.profile import numeric_columns, string_columns

ID_COLUMNS = ("stay_id", "subject_id", "hadm_id", "ed_intime", "ed_outtime", "chiefcomplaint", "fold")
MISSING = "_missing_"
C_GRID = (0.01, 0.1, 1.0, 10.0)
#: depth, and least rows in a leaf
BOOSTING_GRID = ((3, 1), (3, 5), (5, 1), (5, 5))
#: rows of a partition in the grid's fits: many run side by side, and each passes over its rows some ten times a tree
BOOSTING_ROWS = 250_000
#: relative gain of a tree on the validation rows below which boosting ends
LEAST_GAIN = 1e-4
#: rows above which trees are grown over packed blocks; at about so many boosting without validation takes as long as Spark ML's
BLOCKED_ROWS = 1_000_000


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric and text columns that are neither ids, times nor outcomes."""
    skip = lambda c: c in ID_COLUMNS or c == "y" or c.startswith("y_")
    usable = set(numeric_columns(df)) | set(string_columns(df))
    return [c for c in df.columns if c in usable and not skip(c)]


@dataclass
class Preparation:
    """Encoder, medians and scaler, all fitted on one training set."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    codes: DataFrame | None
    assembler: VectorAssembler
    scaler: object | None = None

    def _encoded(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric})
        for c in self.categorical:
            own = self.codes.where(F.col("column_name") == c).select(F.col("value").alias("_v"), F.col("code").alias(f"_i_{c}"))
            # values not seen in training share code 0 with the first category
            out = out.join(own, F.coalesce(F.col(c), F.lit(MISSING)) == F.col("_v"), "left").drop("_v")
            out = out.withColumn(f"_x_{c}", F.coalesce(f"_i_{c}", F.lit(0.0)))
        return out

    def fit_scaler(self, train: DataFrame) -> None:
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
        self.scaler = scaler.fit(self.assembler.transform(self._encoded(train)))

    def restricted(self, columns: Sequence[str]) -> Preparation:
        """The same encoder and medians for some of the columns, without a scaler."""
        return Preparation(
            [c for c in columns if c in self.numeric], [c for c in columns if c in self.categorical], self.medians, self.codes, assembler_of(columns)
        )

    def apply(self, df: DataFrame) -> DataFrame:
        assembled = self.assembler.transform(self._encoded(df))
        assembled = self.scaler.transform(assembled) if self.scaler else assembled.withColumnRenamed("raw", "features")
        hidden = [c for c in assembled.columns if c.startswith(("_x_", "_i_"))]
        return assembled.drop(*hidden)


def assembler_of(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="raw")


def sorted_codes(found: DataFrame, folds: Sequence[int | None]) -> DataFrame:
    """(without, column_name, value, code): the rank of every value of a column in sorted order, from 0, among the rows outside fold ``without``.

    ``found`` has the distinct (fold, column_name, value). A written table that is joined back, whatever its size; no dictionary
    is held on one machine.
    """
    own = found.groupBy("column_name", "value").agg(F.collect_set("fold").alias("_in"))  # as many as there are folds at most
    fitted = F.array(*[F.when(F.size(F.array_remove("_in", i)) > 0, F.lit(i)) if i is not None else F.lit(-1) for i in folds])
    each = own.select(F.explode(F.array_compact(fitted)).alias("without"), "column_name", "value")
    ranked = positions(each, ["without", "column_name"], [F.col("value")], "code")
    return materialize(ranked.select("without", "column_name", "value", (F.col("code") - 1).cast("double").alias("code")))


#: share of the rows on either side of the middle within which the medians are looked for first, and the error of the bounds
NEAR_MIDDLE, BOUND_ERROR = 0.02, 0.005


def _medians_within(
    df: DataFrame, bounds: Mapping[str, tuple[float, float] | None], folds: Sequence[int | None]
) -> dict[tuple[str, int | None], float | None]:
    """Exact median of each column over the rows outside each fold, where it lies within the column's bounds.

    Rows below the bounds are only counted; values within them are ordered once for all folds. A column without values has None.
    """
    columns = list(bounds)
    inside, below = {}, {}
    for c in columns:
        v = F.col(c)
        inside[c], below[c] = v.isNotNull(), F.lit(False)
        if bounds[c]:
            low, high = (F.lit(b) for b in bounds[c])
            inside[c], below[c] = v.between(low, high), v < low
    aggs = [a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.count_if(below[c]).alias(f"b{i}"))]
    sizes = df.groupBy("fold").agg(*aggs).collect()  # a row per fold
    pairs = F.explode(F.array_compact(F.array(*[
        F.when(inside[c], F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c in columns
    ])))
    freq = df.select("fold", pairs.alias("x")).groupBy("x.column_name", "x.value").agg(*[
        F.count_if(F.lit(True) if f is None else F.col("fold") != f).alias(f"_n{j}") for j, f in enumerate(folds)
    ])
    scanned = running(freq, ["column_name"], [F.col("value")], {f"_c{j}": ("sum", F.col(f"_n{j}")) for j in range(len(folds))})
    # per column the places of both middle values within the bounds, an element per fold
    kept = [[r for r in sizes if f is None or r["fold"] != f] for f in folds]
    n = {(c, j): sum(r[f"n{i}"] for r in kept[j]) for i, c in enumerate(columns) for j in range(len(folds))}
    before = {(c, j): sum(r[f"b{i}"] for r in kept[j]) for i, c in enumerate(columns) for j in range(len(folds))}
    places = [(c, *[[at(n[c, j]) - before[c, j] for j in range(len(folds))] for at in (lambda m: (m - 1) // 2, lambda m: m // 2)]) for c in columns]
    places = df.sparkSession.createDataFrame(places, "_c string, lo array<long>, hi array<long>")
    covers = lambda side, j: (F.col(f"_c{j}") - F.col(f"_n{j}") <= F.col(side)[j]) & (F.col(side)[j] < F.col(f"_c{j}"))
    picks = [F.max(F.when(covers(side, j), F.col("value"))).alias(f"{side}{j}") for j in range(len(folds)) for side in ("lo", "hi")]
    rows = scanned.join(F.broadcast(places), F.col("column_name") == F.col("_c")).groupBy("column_name").agg(*picks).collect()  # a row per column
    found = {r["column_name"]: r for r in rows}
    out = {}
    for j, f in enumerate(folds):
        for c in columns:
            lo, hi = (found[c][f"{side}{j}"] if c in found else None for side in ("lo", "hi"))
            if not n[c, j]:
                out[c, f] = None
            elif lo is not None and hi is not None:
                out[c, f] = lo + (hi - lo) * ((n[c, j] - 1) * 0.5 % 1)
    return out


def medians_without(df: DataFrame, columns: Sequence[str], folds: Sequence[int | None]) -> list[dict[str, float]]:
    """Exact medians of ``columns`` over the rows outside each fold (all rows for None), 0 for a column without values.

    All folds share the passes: bounds around the middle by quantile sketches over all rows, then the exact search
    between them. Columns with a median outside their bounds are searched again without bounds.
    """
    slim = df.select("fold", *[F.col(c).cast("double").alias(c) for c in columns])
    sketched = slim.stat.approxQuantile(list(columns), [0.5 - NEAR_MIDDLE, 0.5 + NEAR_MIDDLE], BOUND_ERROR)
    bounds = {c: (b[0], b[1]) if b else None for c, b in zip(columns, sketched, strict=True)}
    found = _medians_within(slim, bounds, folds)
    missed = [c for c in columns if any((c, f) not in found for f in folds)]
    if missed:
        found |= _medians_within(slim, dict.fromkeys(missed), folds)
    return [{c: 0.0 if found[c, f] is None else found[c, f] for c in columns} for f in folds]


def fit_preparations(
    df: DataFrame, columns: Sequence[str], folds: Sequence[int | None] = (None,), scale: bool = True
) -> list[Preparation]:
    """For each fold, a preparation fitted on the rows outside it (on all rows for None): sorted label encoding, exact
    medians (0 for an empty column), scaling. Medians and codes of all folds come from the same passes over ``df``."""
    texts = set(string_columns(df))
    categorical = [c for c in columns if c in texts]
    numeric = [c for c in columns if c not in texts]
    df = df.withColumn("fold", F.lit(0)) if None in folds else df
    medians = medians_without(df, numeric, folds) if numeric else [{} for _ in folds]
    codes = None
    if categorical:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(MISSING)).alias("value")) for c in categorical]))
        codes = sorted_codes(df.select("fold", pairs.alias("p")).select("fold", "p.column_name", "p.value").distinct(), folds)
    preps = []
    for f, m in zip(folds, medians, strict=True):
        own = codes.where(F.col("without") == (-1 if f is None else f)) if categorical else None
        preps.append(Preparation(numeric, categorical, m, own, assembler_of(columns)))
    if scale:
        at_once([lambda p=p, f=f: p.fit_scaler(df if f is None else df.where(F.col("fold") != f)) for p, f in zip(preps, folds, strict=True)], df)
    return preps


def fit_preparation(train: DataFrame, columns: Sequence[str] | None = None, scale: bool = True) -> Preparation:
    """Fit on training rows only: sorted label encoding, exact medians (0 for an empty column), scaling."""
    return fit_preparations(train, list(columns or feature_columns(train)), scale=scale)[0]


def feature_matrix(df: DataFrame, key: str = "stay_id", label: str = "y", columns: Sequence[str] | None = None) -> DataFrame:
    """(key, label, features) with encoder and medians of the whole set, unscaled."""
    prep = fit_preparation(df, columns, scale=False)
    return prep.apply(df).select(key, label, "features")


def balanced_weights(train: DataFrame, label: str = "y", counts: Row | None = None) -> DataFrame:
    """Add ``weight`` = n / (2 n_class)."""
    n = counts or class_counts(train, label)
    pos, neg = n.n / (2.0 * max(n.p or 0, 1)), n.n / (2.0 * max(n.n - (n.p or 0), 1))
    return train.withColumn("weight", F.when(F.col(label) == 1, pos).otherwise(neg))


def class_counts(train: DataFrame, label: str = "y") -> Row:
    """Rows (n) and positives (p)."""
    return train.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()


def _score(model, df: DataFrame) -> DataFrame:
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def logistic(c: float = 1.0, max_iter: int = 100) -> Callable[[DataFrame, str], object]:
    """Balanced logistic regression; inverse penalty ``c`` divides by the row count to match Spark's mean loss."""
    def fit(train: DataFrame, label: str):
        counts = class_counts(train, label)
        weighted = balanced_weights(train, label, counts)
        reg = 1.0 / (c * max(counts.n, 1))
        return LogisticRegression(
            labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter, standardization=False
        ).fit(weighted)
    return fit


def boosted_trees(
    trees: int = 100, depth: int = 5, step: float = 0.05, validation: str | None = None, seed: int = 42,
    least_rows: int = 1, columns: float = 1.0, gain: float = LEAST_GAIN,
):
    """Gradient boosting; a boolean validation column ends it with the first tree that gains less than ``gain`` on its rows.

    Spark ML's, and above ``BLOCKED_ROWS`` rows without validation the same method over packed blocks (``boosting.fit_blocks``).
    """
    def fit(train: DataFrame, label: str):
        if not validation and columns == 1.0 and depth <= 8 and (rows := train.count()) > BLOCKED_ROWS:
            return fit_blocks(train, label, rows, trees, depth, step, 0.8, least_rows, seed)
        gbt = GBTClassifier(
            labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=seed, minInstancesPerNode=least_rows,
            featureSubsetStrategy="all" if columns == 1.0 else str(columns), validationTol=gain,
        )
        if validation:
            gbt = gbt.setValidationIndicatorCol(validation)
        return gbt.fit(train)
    return fit


def boosted_grid(
    trees: int = 500, step: float = 0.05, grid: Sequence[tuple[int, int]] = BOOSTING_GRID, group: str = "subject_id", seed: int = 42,
    gain: float = LEAST_GAIN, columns: float = 0.8,
):
    """Boosting stopped early on a fifth of the groups; the grid point (depth, least rows in a leaf) with the best AUROC there.

    The points are fitted at the same time over one written matrix in as few partitions as its size allows; above ``BLOCKED_ROWS``
    rows by the same method over packed blocks (``boosting_grid.fit_grid``).
    """
    def fit(train: DataFrame, label: str):
        slim = train.select("features", label, (group_fold(group, 5, seed + 1) == 0).alias("_validation"))
        matrix = compact(slim, BOOSTING_ROWS)
        held = matrix.where("_validation")
        if max(depth for depth, _ in grid) <= TABLE_LEVEL + 1 and matrix.count() > BLOCKED_ROWS:
            models = fit_grid(matrix, label, "_validation", grid, trees, step, columns, gain, seed=seed)
        else:
            fits = [boosted_trees(trees, depth, step, "_validation", seed, least, columns, gain) for depth, least in grid]
            models = at_once([lambda f=f: f(matrix, label) for f in fits], matrix)
        scored = [_score(m, held).select(F.lit(i).alias("_g"), "score", label) for i, m in enumerate(models)]
        aurocs = ranking_metrics(reduce(DataFrame.unionByName, scored), "score", label, ["_g"])
        best = aurocs.orderBy(F.col("auroc").desc_nulls_last(), "_g").first()
        return models[best["_g"] if best else 0]
    return fit


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` written in partitions of about ``rows`` rows, for fits that pass over it very often."""
    written = materialize(df)
    parts = max(1, -(-written.count() // rows))
    return materialize(written.coalesce(parts)) if parts < written.rdd.getNumPartitions() else written


def at_once(tasks: Sequence[Callable], df: DataFrame) -> list:
    """Results of ``tasks``, whose Spark jobs run side by side; for a bounded number of fits."""
    target = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(max(1, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(target(t)) for t in tasks]]


def random_forest(trees: int = 100, depth: int = 5, seed: int = 42):
    """A random forest: Spark ML's, and above ``BLOCKED_ROWS`` rows the same method over packed blocks (``forest.fit_forest``)."""
    def fit(train: DataFrame, label: str):
        if trees > 1 and depth <= TABLE_LEVEL + 1 and (rows := train.count()) > BLOCKED_ROWS:
            return fit_forest(train, label, rows, trees, depth, seed)
        return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(train)
    return fit


def tuned(grid: Mapping[str, Callable], group: str = "subject_id", seed: int = 42):
    """Pick the grid entry with the best AUROC on a held-out third of the groups, then refit on all rows."""
    def fit(train: DataFrame, label: str):
        third = group_fold(group, 3, seed) == 0
        train = materialize(train.select("features", label, third.alias("_held")))  # every grid entry passes over it several times
        inner, held = train.where(~F.col("_held")), train.where("_held")
        scored = [
            _score(f(inner, label), held).select(F.lit(name).alias("_g"), "score", label) for name, f in grid.items()
        ]
        aurocs = ranking_metrics(reduce(DataFrame.unionByName, scored), "score", label, ["_g"])
        best = aurocs.orderBy(F.col("auroc").desc_nulls_last(), "_g").first()
        return grid[best["_g"] if best else next(iter(grid))](train, label)
    return fit


def cross_validate(
    df: DataFrame, columns: Sequence[str], fit: Callable, label: str = "y", k: int = 5,
    group: str | None = "subject_id", key: str = "stay_id", seed: int = 42, scale: bool = True,
) -> DataFrame:
    """Out-of-fold scores (key, group, fold, label, score).

    Folds keep groups together, or balance the classes when ``group`` is None.
    Each preparation is fitted without its fold, all of them in the same passes. Folds are fitted
    side by side; the rows of a fold stay distributed.
    """
    return cross_validate_each(df, {"": columns}, fit, label, k, group, key, seed, scale)[""]


def cross_validate_each(
    df: DataFrame, variants: Mapping[str, Sequence[str]], fit: Callable, label: str = "y", k: int = 5,
    group: str | None = "subject_id", key: str = "stay_id", seed: int = 42, scale: bool = True,
) -> dict[str, DataFrame]:
    """``cross_validate`` for several column sets, which share the written rows, the medians and the codes."""
    every = list(dict.fromkeys(c for columns in variants.values() for c in columns))
    ids = [key] + ([group] if group else [])
    slim = df.select(*dict.fromkeys([*ids, label, *every]))
    if group:
        folded = slim.withColumn("fold", group_fold(group, k, seed))
    else:
        folded = slim.join(stratified_folds(slim, key, label, k, seed), key)
    folded = compact(folded)  # every fold reads the same rows
    preps = fit_preparations(folded, every, range(k), scale=False)

    def scored(i: int, columns: Sequence[str]) -> DataFrame:
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        prep = preps[i].restricted(columns)
        if scale:
            prep.fit_scaler(train)
        model = fit(prep.apply(train), label)
        return _score(model, prep.apply(test)).select(*ids, "fold", label, "score")

    return {
        name: reduce(DataFrame.unionByName, at_once([lambda i=i: scored(i, columns) for i in range(k)], folded))
        for name, columns in variants.items()
    }


def cv_metrics(scores: DataFrame, label: str = "y") -> DataFrame:
    """AUROC, average precision, Brier and threshold metrics per fold."""
    scores = materialize(scores)  # read for the order of the scores and for the counts
    return ranking_metrics(scores, "score", label, ["fold"]).join(threshold_metrics(scores, "score", label, ["fold"]), "fold")


def scored_variants(
    df: DataFrame, variants: Mapping[str, Sequence[str]], fit: Callable, label: str = "y", k: int = 5,
    group: str | None = "subject_id", scale: bool = True, key: str = "stay_id",
) -> DataFrame:
    """Out-of-fold scores of several column sets on the same rows, label and folds."""
    each = cross_validate_each(df, variants, fit, label, k, group, key, scale=scale)
    return reduce(DataFrame.unionByName, [
        each[name].select(F.lit(name).alias("variant"), F.lit(len(columns)).alias("n_features"), key, "fold", label, "score")
        for name, columns in variants.items()
    ])


def compare(
    df: DataFrame, variants: Mapping[str, Sequence[str]], fit: Callable, label: str = "y", k: int = 5,
    group: str | None = "subject_id", scale: bool = True,
) -> DataFrame:
    """(variant, n_features, auroc, average precision) of several column sets on the same rows, label and folds."""
    scores = scored_variants(df, variants, fit, label, k, group, scale)
    metrics = ranking_metrics(scores, "score", label, ["variant", "n_features", "fold"])
    return fold_summary(metrics, ["auroc", "average_precision"], ["variant", "n_features"])


def fold_frame(
    scores: DataFrame, by: Sequence[str] = (), label: str = "y", key: str = "stay_id", expected: tuple[float, float] | None = (0.0, 1.0)
) -> DataFrame:
    """What must hold for out-of-fold scores, per fold: rows, positives, whether every row is scored once with a
    probability, and (where ``expected`` is given) whether the AUROC lies within it."""
    ids = [*by, "fold"]
    scores = materialize(scores)  # read for the counts and for the order of the scores
    counts = scores.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(label).cast("long").alias("n_positive"), F.count_distinct(key).alias("_keys"),
        F.min(F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("probabilities"),
    )
    out = counts.select(*ids, "n_rows", "n_positive", (F.col("_keys") == F.col("n_rows")).alias("scored_once"), "probabilities")
    if expected is None:
        return out
    within = F.col("auroc").between(*expected).alias("auroc_as_expected")
    return out.join(ranking_metrics(scores, "score", label, ids).select(*ids, within), ids)


def with_delta(compared: DataFrame, baseline: str) -> DataFrame:
    """Add AUROC difference and relative inflation against the baseline variant."""
    base = compared.where(F.col("variant") == baseline).select(F.col("auroc_mean").alias("_b"), F.lit(1).alias("_one"))
    return (
        compared.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")  # one row
        .withColumn("delta_auroc", F.col("auroc_mean") - F.col("_b"))
        .withColumn("inflation_pct", 100.0 * F.try_divide("delta_auroc", "_b"))
        .drop("_b", "_one")
    )


def leakage_experiment(
    df: DataFrame, isolated: Sequence[str], contaminated: Sequence[str], fit: Callable, label: str = "y", k: int = 5
) -> DataFrame:
    """Features that end at the prediction time against features that run past it; same rows, label and folds."""
    compared = compare(df, {"isolated": isolated, "contaminated": contaminated}, fit, label, k)
    return with_delta(compared, "isolated")


def permuted_labels(df: DataFrame, label: str = "y", seed: int = 43) -> DataFrame:
    """``df`` with the labels dealt out anew."""
    return df.drop(label).join(shuffled_labels(df, "stay_id", label, seed), "stay_id")


def shuffled_control(df: DataFrame, columns: Sequence[str], fit: Callable, label: str = "y", k: int = 5, seed: int = 43) -> DataFrame:
    """The same model on permuted labels: AUROC should be near one half."""
    return compare(permuted_labels(df, label, seed), {"shuffled": columns}, fit, label, k)


# Name stems of the feature groups
ABLATION_GROUPS = {
    "demographics": ("age_at_ed", "gender", "arrival_transport", "race"),
    "vitals": ("sbp_", "hr_", "rr_", "spo2_", "temp_", "n_vitalsign"),
    "labs": ("lactate", "troponin", "creatinine", "potassium", "sodium", "bicarbonate", "wbc", "hemoglobin", "platelet", "is_hs"),
    "process": ("ed_los", "time_to_first", "prev_admits", "prev_ed_visits"),
    "missing": ("missing",),
}


def ablation_sets(columns: Sequence[str]) -> dict[str, list[str]]:
    """Growing column sets: each group of the name rules is added to the ones before."""
    out, so_far = {}, []
    for name, stems in ABLATION_GROUPS.items():
        own = [
            c for c in columns
            if any(s in c for s in stems) and ((name == "missing") == ("missing" in c)) and c not in so_far
        ]
        so_far = so_far + own
        if own:
            out[f"+{name}" if out else name] = list(so_far)
    return out


def feature_importance(df: DataFrame, columns: Sequence[str], fit: Callable, label: str = "y") -> DataFrame:
    """(feature, importance) of a tree model fitted on all rows, largest first."""
    prep = fit_preparation(df, columns, scale=False)
    model = fit(prep.apply(df), label)
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def scored_labels(df: DataFrame, columns: Sequence[str], labels: Sequence[str], fit: Callable, k: int = 5, key: str = "stay_id") -> DataFrame:
    """Out-of-fold scores of one feature set for several labels (``outcome``, label ``_y``)."""
    parts = []
    for name in labels:
        scores = cross_validate(df, columns, fit, name, k, key=key, scale=False)
        parts.append(scores.select(F.lit(name).alias("outcome"), key, "fold", F.col(name).alias("_y"), "score"))
    return reduce(DataFrame.unionByName, parts)


def multi_label(df: DataFrame, columns: Sequence[str], labels: Sequence[str], fit: Callable, k: int = 5) -> DataFrame:
    """One feature set, several labels: AUROC over shared folds per label."""
    metrics = ranking_metrics(scored_labels(df, columns, labels, fit, k), "score", "_y", ["outcome", "fold"])
    return fold_summary(metrics, ["auroc"], ["outcome"])


def result_table(results: Mapping[str, DataFrame], column: str = "experiment") -> DataFrame:
    """Results of several experiments stacked with their names."""
    parts = [df.select(F.lit(name).alias(column), "*") for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
