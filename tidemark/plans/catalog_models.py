"""Model queries: data preparation, and fits and experiments, which have no SQL counterpart."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.session import materialize
from tidemark.operators import dataset as D
from tidemark.operators import model as M
from tidemark.plans.oracle import q, r6
from tidemark.plans.registry import query, rounded

FOLDS = 5
#: the published runs: iterations of every logistic fit; trees, depth and step of boosting, also taken for the forest
ITERATIONS = 1000
TREES, DEPTH, STEP = 200, 5, 0.05
#: trees at most of the boosting grid, which ends early
MOST_TREES = 500


def visits(t) -> DataFrame:
    """First-hour features of every stay with admission as label."""
    y = t.staged.select("stay_id", "subject_id", F.col("was_admitted").alias("y"))
    return materialize(y.join(t.features(R.W1), "stay_id"))


def orders_table(t) -> DataFrame:
    """Orders with line-item aggregates, customer attributes and two labels."""
    lines = t.read("lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
        F.max("l_extendedprice").alias("top_price"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
    )
    orders = t.read("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    customers = t.read("customer", "c_custkey", "c_mktsegment", "c_acctbal")
    joined = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .join(customers, orders.o_custkey == customers.c_custkey, "left")
    )
    return materialize(joined.select(
        F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"), "n_lines", "quantity", "discount", "top_price",
        F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), F.coalesce("returned", F.lit(0)).alias("y"),
        (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).cast("int").alias("y_urgent"),
    ))


_COLS = ["n_lines", "quantity", "discount", "top_price", "total", "segment", "balance"]


def _matrix(df: DataFrame, width: int, *more: str) -> DataFrame:
    values = vector_to_array("features")
    return df.select("stay_id", "y", *more, *[values[i].alias(f"x{i}") for i in range(width)])


_ORDERS = """
o AS (SELECT o.o_orderkey AS stay_id, o.o_custkey AS subject_id, l.n_lines::DOUBLE AS n_lines, l.quantity, l.discount, l.top_price,
  o.o_totalprice AS total, coalesce(c.c_mktsegment, '_missing_') AS segment, c.c_acctbal AS balance, coalesce(l.returned, 0) AS y,
  (o.o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS y_urgent
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity, avg(l_discount) AS discount,
  max(l_extendedprice) AS top_price, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY 1) l
  ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""


def _matrix_sql(fit: str, scale: bool, more: str = "") -> str:
    """Median fill, sorted codes and optional scaling from the rows of ``fit``, applied to all rows."""
    xs = ", ".join(
        f"coalesce((SELECT count(DISTINCT f.segment) FROM o f WHERE {fit} AND f.segment < o.segment AND EXISTS "
        f"(SELECT 1 FROM o f WHERE {fit} AND f.segment = o.segment)), 0)::DOUBLE AS x{i}" if c == "segment"
        else f"coalesce({c}, (SELECT quantile_cont(f.{c}, 0.5) FROM o f WHERE {fit}), 0) AS x{i}"
        for i, c in enumerate(_COLS)
    )
    names = [f"x{i}" for i in range(len(_COLS))]
    value = lambda n: f"({n} - (SELECT avg(f.{n}) FROM m f WHERE {fit})) / (SELECT stddev_samp(f.{n}) FROM m f WHERE {fit}) AS {n}"
    cols = ", ".join(value(n) if scale else n for n in names)
    return r6(f"WITH {_ORDERS}, m AS (SELECT stay_id, subject_id, y, {xs} FROM o) SELECT stay_id, y, {more}{cols} FROM m o", names)


_FOLD = "('0x' || substr(md5({t}.subject_id::VARCHAR || ':42'), 1, 8))::BIGINT % 5"


@query("feature_matrix", _matrix_sql("TRUE", scale=False))
def feature_matrix(t):
    return rounded(_matrix(M.feature_matrix(orders_table(t), columns=_COLS), len(_COLS)))


@query("leak_free_matrix", _matrix_sql(_FOLD.format(t="f") + " <> 0", scale=True, more=_FOLD.format(t="o") + " = 0 AS held_out, "))
def leak_free_matrix(t):
    df = orders_table(t)
    held_out = M.group_fold("subject_id", 5) == 0
    prep = M.fit_preparation(df.where(~held_out), _COLS)
    return rounded(_matrix(prep.apply(df).withColumn("held_out", held_out), len(_COLS), "held_out"))


# Each fit is registered twice: with its metrics, which no SQL gives, and as ``_frame`` with what must hold of its scores.

def _frame_sql(variants: dict[str, int] | None = None, label: str = "y", auroc: bool = True, rows: str = "o") -> str:
    """Rows and positives per fold (and variant), every row scored once with a probability."""
    fold = _FOLD.format(t="r")
    names, cross = "", ""
    if variants:
        names = "variant, n_features, "
        cross = ", (VALUES " + ", ".join(f"('{v}', {n}::INT)" for v, n in variants.items()) + ") v(variant, n_features)"
    return f"""SELECT {names}({fold})::INT AS fold, count(*) AS n_rows, sum(r.{label})::BIGINT AS n_positive, TRUE AS scored_once, TRUE AS probabilities
{", TRUE AS auroc_as_expected" if auroc else ""} FROM {rows} r{cross} GROUP BY ALL"""


def _orders_frame(**kw) -> str:
    return f"WITH {_ORDERS} {_frame_sql(**kw)}"


def _logistic_scores(t):
    return M.cross_validate(orders_table(t), _COLS, M.logistic(1.0, ITERATIONS), k=FOLDS)


@query("logistic_cv")
def logistic_cv(t):
    return M.cv_metrics(_logistic_scores(t))


@query("logistic_cv_frame", _orders_frame())
def logistic_cv_frame(t):
    return M.fold_frame(_logistic_scores(t), expected=(0.5, 1.0))


def _tuned_scores(t):
    grid = {f"C={c}": M.logistic(c, ITERATIONS) for c in M.C_GRID}
    return M.cross_validate(orders_table(t), _COLS, M.tuned(grid), k=FOLDS)


@query("logistic_grid_cv")
def logistic_grid_cv(t):
    return M.cv_metrics(_tuned_scores(t))


@query("logistic_grid_cv_frame", _orders_frame())
def logistic_grid_cv_frame(t):
    return M.fold_frame(_tuned_scores(t), expected=(0.5, 1.0))


def _boosted_scores(t):
    return M.cross_validate(orders_table(t), _COLS, M.boosted_grid(MOST_TREES, STEP), k=FOLDS, scale=False)


@query("boosted_trees_cv")
def boosted_trees_cv(t):
    return M.cv_metrics(_boosted_scores(t))


@query("boosted_trees_cv_frame", _orders_frame())
def boosted_trees_cv_frame(t):
    return M.fold_frame(_boosted_scores(t), expected=(0.5, 1.0))


_BLOCKS = {"orders": ["total", "balance"], "orders and lines": ["total", "balance", "n_lines", "quantity", "discount", "top_price"]}


@query("incremental_value")
def incremental_value(t):
    return M.with_delta(M.compare(orders_table(t), _BLOCKS, M.logistic(1.0, ITERATIONS), k=FOLDS), "orders")


@query("incremental_value_frame", _orders_frame(variants={v: len(c) for v, c in _BLOCKS.items()}))
def incremental_value_frame(t):
    return M.fold_frame(M.scored_variants(orders_table(t), _BLOCKS, M.logistic(1.0, ITERATIONS), k=FOLDS), ["variant", "n_features"])


@query("shuffled_control")
def shuffled_control(t):
    return M.shuffled_control(orders_table(t), _COLS, M.logistic(1.0, ITERATIONS), k=FOLDS)


# the permutation itself has SQL of its own in shuffled_labels
@query("shuffled_control_frame", f"""WITH {_ORDERS},
p AS (SELECT stay_id, subject_id, y, row_number() OVER (ORDER BY stay_id) AS i, row_number() OVER (ORDER BY md5(stay_id::VARCHAR || ':43'), stay_id) AS j FROM o),
s AS (SELECT a.subject_id, b.y FROM p a JOIN p b ON a.i = b.j) {_frame_sql(rows="s")}""")
def shuffled_control_frame(t):
    permuted = M.permuted_labels(orders_table(t))
    return M.fold_frame(M.cross_validate(permuted, _COLS, M.logistic(1.0, ITERATIONS), k=FOLDS), expected=(0.35, 0.65))


def _importance(t):
    return M.feature_importance(orders_table(t), _COLS, M.boosted_trees(TREES, DEPTH, STEP))


@query("feature_importance")
def feature_importance(t):
    return _importance(t)


@query("feature_importance_frame", "SELECT *, TRUE AS not_negative, TRUE AS sums_to_one FROM (VALUES " + ", ".join(f"('{c}')" for c in _COLS) + ") v(feature)")
def feature_importance_frame(t):
    found = materialize(_importance(t))
    total = found.agg(F.sum("importance").alias("_total"))
    return found.join(F.broadcast(total)).select("feature", (F.col("importance") >= 0).alias("not_negative"), (F.abs(F.col("_total") - 1) < 1e-6).alias("sums_to_one"))


_OUTCOMES = ["y", "y_urgent"]


@query("multi_label_forest")
def multi_label_forest(t):
    return M.multi_label(orders_table(t), _COLS, _OUTCOMES, M.random_forest(TREES, DEPTH), k=FOLDS)


@query("multi_label_forest_frame", f"WITH {_ORDERS} SELECT 'y' AS outcome, * FROM ({_frame_sql()}) UNION ALL SELECT 'y_urgent', * FROM ({_frame_sql(label='y_urgent')})")
def multi_label_forest_frame(t):
    return M.fold_frame(M.scored_labels(orders_table(t), _COLS, _OUTCOMES, M.random_forest(TREES, DEPTH), FOLDS), ["outcome"], "_y")


@query("feature_ablation")
def feature_ablation(t):
    df = visits(t)
    return M.compare(df, M.ablation_sets(M.feature_columns(df)), M.logistic(1.0, ITERATIONS), k=FOLDS)


@query("feature_ablation_frame", q("WITH r AS (SELECT subject_id, was_admitted AS y FROM cohort) " + _frame_sql({"demographics": 4, "+vitals": 9, "+missing": 12}, auroc=False, rows="r")))
def feature_ablation_frame(t):
    df = visits(t)
    scores = M.scored_variants(df, M.ablation_sets(M.feature_columns(df)), M.logistic(1.0, ITERATIONS), k=FOLDS)
    return M.fold_frame(scores, ["variant", "n_features"], expected=None)


def _leak_inputs(t):
    spec = D.DatasetSpec("leak", ("W6", "W24"), ("deterioration_24h_from_w6",), missing_threshold=None)
    df = materialize(D.assemble(t.staged, t.features(R.W6, R.W24), t.labels, spec))
    pairs = D.matched_columns([c for c in df.columns if c.endswith("_6h")], df.columns)
    return df, [a for a, _ in pairs], [b for _, b in pairs]


@query("leakage_experiment")
def leakage_experiment(t):
    df, isolated, contaminated = _leak_inputs(t)
    return M.leakage_experiment(df, isolated, contaminated, M.logistic(1.0, ITERATIONS), k=FOLDS)


@query("leakage_experiment_frame", q("WITH r AS (SELECT subject_id, deterioration_24h_from_w6 AS y FROM labels) " + _frame_sql({"isolated": 23, "contaminated": 23}, auroc=False, rows="r")))
def leakage_experiment_frame(t):
    df, isolated, contaminated = _leak_inputs(t)
    scores = M.scored_variants(df, {"isolated": isolated, "contaminated": contaminated}, M.logistic(1.0, ITERATIONS), k=FOLDS)
    return M.fold_frame(scores, ["variant", "n_features"], expected=None)


def _two_tables(t):
    df = orders_table(t)
    parts = {n: M.compare(df, {"all": c}, M.logistic(1.0, ITERATIONS), k=FOLDS) for n, c in (("lines", ["n_lines", "quantity"]), ("money", ["total", "balance"]))}
    return M.result_table(parts)


@query("result_table")
def result_table(t):
    return _two_tables(t)


@query("result_table_frame", "SELECT *, 2::INT AS n_features, 5::BIGINT AS n_folds, TRUE AS ordered FROM (VALUES ('lines', 'all'), ('money', 'all')) v(experiment, variant)")
def result_table_frame(t):
    ordered = F.col("auroc_mean").between(F.col("auroc_min"), F.col("auroc_max")) & F.col("auroc_mean").between(0, 1)
    return _two_tables(t).select("experiment", "variant", "n_features", "n_folds", ordered.alias("ordered"))
