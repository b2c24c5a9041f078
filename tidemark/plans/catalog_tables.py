"""Queries on orders, line items and documents: joins, profiles, sampling, metrics.

Orders act as admissions, their line items as laboratory values with parts as
dictionary. ``profiled`` is a line-item table with missing values and a 0/1
label; ``scored`` puts a text-length score next to a quality label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.matching import any_keyword, first_class
from tidemark.functions.ordered import RangeCount, range_counts
from tidemark.functions.timeops import interval_join
from tidemark.operators import evaluate as V
from tidemark.operators import events as E
from tidemark.operators import profile as P
from tidemark.operators import qa as Q
from tidemark.plans.oracle import q, r6
from tidemark.plans.registry import query, rounded
from tidemark.sources.inspect import row_counts

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_row_counts(t):
    return row_counts({name: t.read(name) for name in TABLES})


# --- interval joins and dictionaries ---------------------------------------------------


def order_anchors(t) -> DataFrame:
    return t.read("orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("t_in"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("t_end"),
    )


def order_lines(t) -> DataFrame:
    return t.read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity").select(
        F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("itemid"),
        F.col("l_shipdate").alias("charttime"), F.col("l_quantity").alias("valuenum"),
    )


_IN = "l.l_orderkey = o.o_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 90 DAY"


@query("interval_join_inner", f"""
SELECT o.o_orderkey AS hadm_id, o.o_custkey AS subject_id, l.l_linenumber AS line, l.l_partkey AS itemid, l.l_shipdate AS charttime,
       l.l_quantity AS valuenum FROM orders o JOIN lineitem l ON {_IN}""")
def interval_join_inner(t):
    joined = interval_join(order_anchors(t), order_lines(t), ["hadm_id"], "charttime", "t_in", "t_end")
    return joined.select("hadm_id", "subject_id", "line", "itemid", "charttime", "valuenum")


@query("interval_left_counts", f"""
SELECT o.o_orderkey AS hadm_id, count(l.l_shipdate) AS n_lines, count(DISTINCT l.l_partkey) AS n_items
FROM orders o LEFT JOIN lineitem l ON {_IN} GROUP BY 1""")
def interval_left_counts(t):
    joined = interval_join(order_anchors(t), order_lines(t), ["hadm_id"], "charttime", "t_in", "t_end", "left")
    return joined.groupBy("hadm_id").agg(F.count("charttime").alias("n_lines"), F.count_distinct("itemid").alias("n_items"))


@query("interval_left_unmatched", f"""
SELECT o.o_orderkey AS hadm_id FROM orders o LEFT JOIN lineitem l ON {_IN} WHERE l.l_orderkey IS NULL""")
def interval_left_unmatched(t):
    joined = interval_join(order_anchors(t), order_lines(t), ["hadm_id"], "charttime", "t_in", "t_end", "left")
    return joined.where(F.col("charttime").isNull()).select("hadm_id")


@query("keyword_dictionary", """
SELECT p.p_name AS label, count(*) AS n_lines, sum(l.l_quantity) AS total FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
WHERE lower(p.p_name) LIKE '%bolt%' OR lower(p.p_name) LIKE '%ring%' GROUP BY 1""")
def keyword_dictionary(t):
    parts = t.read("part", "p_partkey", "p_name").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    lines = t.read("lineitem", "l_partkey", "l_quantity")
    hits = lines.join(E.keyword_items(parts, ("Bolt", "RING")), F.col("l_partkey") == F.col("itemid"))
    return hits.groupBy("label").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("total"))


_CLASSES = (("bolt", ("bolt",)), ("ring", ("ring",)), ("red", ("red",)), ("widget", ("widget", "gizmo")))
_CASE = "CASE WHEN p_name LIKE '%bolt%' THEN 'bolt' WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%red%' THEN 'red' WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'widget' END"
_LABS = f"""
SELECT o.o_orderkey AS hadm_id, o.o_orderdate AS t_in, l.l_shipdate AS charttime, l.l_quantity AS valuenum, p.lab_type,
       row_number() OVER (PARTITION BY o.o_orderkey, p.lab_type ORDER BY l.l_shipdate, l.l_quantity) AS rn
FROM orders o JOIN lineitem l ON {_IN} JOIN (SELECT p_partkey, {_CASE} AS lab_type FROM part) p ON p.p_partkey = l.l_partkey
WHERE p.lab_type IS NOT NULL AND l.l_quantity > 5"""


def _classified_lines(t) -> DataFrame:
    label = F.col("p_name")
    words = [w for _, ws in _CLASSES for w in ws]
    items = t.read("part", "p_partkey", "p_name").where(any_keyword(label, words)).select(
        F.col("p_partkey").alias("itemid"), first_class(label, _CLASSES).alias("lab_type")
    )
    lines = order_lines(t).where(F.col("valuenum") > 5).join(items, "itemid")
    return interval_join(order_anchors(t), lines, ["hadm_id"], "charttime", "t_in", "t_end")


@query("first_lab_pivot", "SELECT hadm_id, " + ", ".join(
    f"max(CASE WHEN lab_type = '{c}' AND rn = 1 THEN valuenum END) AS {c}_first" for c, _ in _CLASSES) + f" FROM ({_LABS}) GROUP BY 1")
def first_lab_pivot(t):
    point = F.struct("charttime", "valuenum")
    first = lambda c: F.min(F.when(F.col("lab_type") == c, point))
    picked = _classified_lines(t).groupBy("hadm_id").agg(*[first(c).alias(c) for c, _ in _CLASSES])
    return picked.select("hadm_id", *[F.col(f"{c}.valuenum").alias(f"{c}_first") for c, _ in _CLASSES])


@query("lab_max_delta", f"""
SELECT hadm_id, max(valuenum) AS max_value, max(valuenum) - max(CASE WHEN rf = 1 THEN valuenum END) AS delta,
       count(*) AS n_values FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime, valuenum) AS rf FROM ({_LABS}))
GROUP BY 1""")
def lab_max_delta(t):
    first = F.min(F.struct("charttime", "valuenum"))["valuenum"]
    return _classified_lines(t).groupBy("hadm_id").agg(
        F.max("valuenum").alias("max_value"), (F.max("valuenum") - first).alias("delta"), F.count(F.lit(1)).alias("n_values")
    )


@query("range_history_counts", """
SELECT o.o_orderkey, (SELECT count(*) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate >= o.o_orderdate - INTERVAL 1 YEAR
  AND p.o_orderdate < o.o_orderdate) AS n_prior_year,
  (SELECT count(*) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate > o.o_orderdate
  AND p.o_orderdate <= o.o_orderdate + INTERVAL 30 DAY) AS n_next_month FROM orders o""")
def range_history_counts(t):
    orders = t.read("orders", "o_orderkey", "o_custkey", "o_orderdate")
    at = F.col("o_orderdate")
    return range_counts(orders, "o_orderkey", "o_custkey", {"orders": (orders, "o_orderdate")}, {
        "n_prior_year": RangeCount("orders", at - F.expr("INTERVAL 1 YEAR"), at),
        "n_next_month": RangeCount("orders", at, at + F.expr("INTERVAL 30 DAYS"), lo_closed=False, hi_closed=True),
    })


# --- profiles ---------------------------------------------------------------------------

_PROFILED = """
SELECT l_orderkey AS stay_id, l_suppkey AS subject_id, l_quantity AS quantity, l_extendedprice AS price, l_quantity * 2 + l_tax AS scaled,
       CASE WHEN l_discount > 0.02 THEN l_discount END AS discount, CASE WHEN l_tax > 0.04 THEN l_tax END AS tax,
       CASE WHEN l_linenumber < 4 THEN l_linenumber::DOUBLE END AS line, l_returnflag AS flag, l_linestatus AS status,
       l_quantity::INTEGER::VARCHAR AS quantity_text, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem"""
_NUM = ("quantity", "price", "scaled", "discount", "tax", "line")


def profiled(t) -> DataFrame:
    l = t.read("lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
               "l_returnflag", "l_linestatus")
    return l.select(
        F.col("l_orderkey").alias("stay_id"), F.col("l_suppkey").alias("subject_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("scaled"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_linenumber") < 4, F.col("l_linenumber").cast("double")).alias("line"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity_text"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def _each(template: str, columns=_NUM) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


_D = f"WITH d AS ({_PROFILED}) "
_MISSING = "count(*) - count({c}) AS n_missing, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS pct_missing"
_MOMENTS = "min({c}) AS min_value, max({c}) AS max_value, avg({c}) AS mean_value, stddev_samp({c}) AS std_value"


@query("basic_info", f"SELECT count(*) AS n_rows, 12 AS n_columns FROM ({_PROFILED})")
def basic_info(t):
    return P.basic_info(profiled(t))


@query("column_profile", q(r6(_D + _each(
    f"SELECT '{{c}}' AS column_name, {_MISSING}, {_MOMENTS}, count(DISTINCT {{c}}) AS n_unique, quantile_cont({{c}}, 0.25) AS q25, "
    "quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, "
    "CASE WHEN min({c}) = max({c}) AND count({c}) > 1 THEN 1 ELSE 0 END AS is_constant FROM d"),
    "pct_missing min_value max_value mean_value std_value q25 median q75", 4)))
def column_profile(t):
    return rounded(P.column_profile(profiled(t), _NUM), 4)


@query("column_statistics", q(r6(_D + _each(f"SELECT '{{c}}' AS column_name, {_MISSING}, {_MOMENTS} FROM d"),
                                 "pct_missing min_value max_value mean_value std_value", 4)))
def column_statistics(t):
    return rounded(P.column_statistics(profiled(t), _NUM), 4)


@query("value_counts", q(_D + """
SELECT *, count(*) OVER (PARTITION BY column_name) AS n_distinct FROM (
SELECT 'flag' AS column_name, flag AS value, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'quantity_text', quantity_text, count(*) FROM d GROUP BY 2)"""))
def value_counts(t):
    return P.value_counts(profiled(t), ["flag", "status", "quantity_text"])


_PC = ("stay_id", "subject_id", "quantity", "price", "scaled", "discount", "tax", "line", "flag", "status", "quantity_text", "y")


@query("missing_summary", q(r6(_D + f"""
, m AS (SELECT count(*) AS n, [{', '.join(f'count(*) - count({c})' for c in _PC)}] AS m FROM d)
SELECT list_sum(m)::BIGINT AS total_missing_cells, n * 12 AS total_cells, 100.0::DOUBLE * list_sum(m) / (n * 12) AS pct_missing_overall,
       len(list_filter(m, lambda x: x > 0))::INTEGER AS columns_with_missing, len(list_filter(m, lambda x: x = 0))::INTEGER AS columns_fully_complete,
       len(list_filter(m, lambda x: x > 0.5 * n))::INTEGER AS columns_over_half_missing FROM m""", "pct_missing_overall")))
def missing_summary(t):
    return rounded(P.missing_summary(profiled(t)))


@query("missing_ranking", q(r6(_D + "SELECT * FROM (" + _each(
    "SELECT '{c}' AS column_name, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS pct_missing FROM d", _PC) + ") WHERE pct_missing > 0",
    "pct_missing")))
def missing_ranking(t):
    return rounded(P.missing_ranking(profiled(t)))


@query("outcome_summary", q(r6(_D + """
SELECT count(*) FILTER (WHERE y = 1) AS n_positive, count(*) FILTER (WHERE y = 0) AS n_negative, avg(y) AS outcome_rate,
       2 * least(avg(y), 1 - avg(y)) AS class_balance,
       CASE WHEN avg(y) < 0.01 THEN 'very low' WHEN avg(y) < 0.05 THEN 'low' WHEN avg(y) > 0.5 THEN 'high' ELSE 'ok' END AS warning FROM d""",
    "outcome_rate class_balance")))
def outcome_summary(t):
    return rounded(P.outcome_summary(profiled(t)))


_OUTLIERS = """
SELECT '{c}' AS column_name, any_value(n) AS n_values, (any_value(n) < 10)::INTEGER AS few_values, any_value(lo) AS lower_bound, any_value(hi) AS upper_bound,
       count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_outliers_iqr, count(*) FILTER (WHERE abs({c} - mu) > 3 * sd) AS n_outliers_zscore
FROM d, (SELECT count({c}) AS n, avg({c}) AS mu, stddev_samp({c}) AS sd, count(DISTINCT {c}) AS u,
  quantile_cont({c}, 0.25) - 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM d)
WHERE {c} IS NOT NULL AND u > 2"""


@query("outliers_iqr_z", q(r6(_D + _each(_OUTLIERS, _NUM), "lower_bound upper_bound")))
def outliers_iqr_z(t):
    return rounded(P.outliers(profiled(t), _NUM))


_WIDE = [f"w{i}" for i in range(1, 46)]


def wide(t) -> DataFrame:
    """Orders with 45 numeric columns and an outcome: nothing may depend on how many columns there are."""
    o = t.read("orders", "o_orderkey", "o_custkey", "o_totalprice")
    columns = [F.pmod(F.col("o_custkey") * i + F.col("o_orderkey"), F.lit(97 + i)).cast("int").alias(f"w{i}") for i in range(1, 46)]
    return o.select(F.col("o_orderkey").alias("stay_id"), *columns, (F.col("o_totalprice") > 150000).cast("int").alias("y"))


_WIDE_D = ("WITH d AS (SELECT o_orderkey AS stay_id, " + ", ".join(f"((o_custkey * {i} + o_orderkey) % {97 + i})::INTEGER AS w{i}" for i in range(1, 46))
           + ", (o_totalprice > 150000)::INTEGER AS y FROM orders) ")


@query("outliers_wide", q(r6(_WIDE_D + _each(_OUTLIERS, [*_WIDE, "stay_id"]), "lower_bound upper_bound")))
def outliers_wide(t):
    return rounded(P.outliers(wide(t)))


@query("report_correlations_wide", q(r6(_WIDE_D + _each("SELECT '{c}' AS column_name, corr({c}, y) AS correlation FROM d", _WIDE), "correlation")))
def report_correlations_wide(t):
    return rounded(P.quality_report(wide(t))["correlations"])


@query("corr_with_y", q(r6(_D + _each("SELECT '{c}' AS column_name, corr({c}, y) AS correlation FROM d"), "correlation")))
def corr_with_y(t):
    return rounded(P.correlations_with(profiled(t), "y", _NUM))


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM d" for a, b in _PAIRS)


@query("correlation_matrix", q(r6(_D + _CORR, "correlation")))
def correlation_matrix(t):
    return rounded(P.correlation_pairs(profiled(t), _NUM))


@query("high_corr_pairs", q(r6(_D + f"SELECT * FROM ({_CORR}) WHERE abs(correlation) > 0.8", "correlation")))
def high_corr_pairs(t):
    return rounded(P.correlation_pairs(profiled(t), _NUM, 0.8))


@query("point_biserial", q(r6(_D + _each("""
SELECT '{c}' AS column_name, corr({c}, y) AS correlation, count({c}) AS n_pairs,
       corr({c}, y) * sqrt((count({c}) - 2) / (1 - corr({c}, y) * corr({c}, y))) AS t_statistic, (count({c}) > 100)::INTEGER AS enough_pairs FROM d"""),
    "correlation t_statistic")))
def point_biserial(t):
    return rounded(P.point_biserial(profiled(t), "y", _NUM))


_RANGE = (("price", 1000.0, 90000.0), ("quantity", 1.0, 50.0))


@query("sanity_checks", q(r6(_D + """
SELECT 'unique_keys' AS check_name, CASE WHEN count(*) = count(DISTINCT stay_id) THEN 'pass' ELSE 'warn' END AS status,
       (count(*) - count(DISTINCT stay_id))::DOUBLE AS value FROM d
UNION ALL SELECT 'outcome_rate_bounds', CASE WHEN avg(y) < 0.001 THEN 'fail' WHEN avg(y) < 0.01 OR avg(y) > 0.5 THEN 'warn' ELSE 'pass' END, avg(y) FROM d
UNION ALL SELECT 'range_price', CASE WHEN avg(CASE WHEN price BETWEEN 1000 AND 90000 THEN 0.0 ELSE 1.0 END) > 0.05 THEN 'warn' ELSE 'pass' END,
  avg(CASE WHEN price BETWEEN 1000 AND 90000 THEN 0.0 ELSE 1.0 END) FROM d
UNION ALL SELECT 'range_quantity', CASE WHEN avg(CASE WHEN quantity BETWEEN 1 AND 50 THEN 0.0 ELSE 1.0 END) > 0.05 THEN 'warn' ELSE 'pass' END,
  avg(CASE WHEN quantity BETWEEN 1 AND 50 THEN 0.0 ELSE 1.0 END) FROM d
UNION ALL SELECT 'all_null_columns', 'pass', 0.0::DOUBLE FROM d HAVING count(*) > 0""", "value")))
def sanity_checks(t):
    return rounded(P.sanity_checks(profiled(t), ranges=_RANGE))


@query("dataset_checks", q(_D + """
, e AS (SELECT *, NULL AS nothing, 5 AS five FROM d)
SELECT 'nothing' AS column_name, 1 AS all_null, 0 AS constant FROM e HAVING count(nothing) = 0 AND count(*) > 0
UNION ALL SELECT 'five', 0, 1 FROM e HAVING count(DISTINCT five) = 1"""))
def dataset_checks(t):
    df = profiled(t).withColumn("nothing", F.lit(None).cast("double")).withColumn("five", F.lit(5))
    return Q.dataset_checks(df).select("column_name", F.col("all_null").cast("int"), F.col("constant").cast("int"))


@query("dataset_metrics", q(r6(_D + "SELECT count(*) AS n_rows, 11 AS n_features, avg(y) AS outcome_rate FROM d", "outcome_rate")))
def dataset_metrics(t):
    return rounded(Q.dataset_metrics(profiled(t)))


_PR = ("quantity", "price", "discount", "line")


@query("quality_score", q(f"""
{_D}, m AS (SELECT avg(y) AS rate, count(*) AS n, [{', '.join(f'count(*) - count({c})' for c in (*_PR, 'stay_id', 'flag', 'y'))}] AS m,
  count(*) - count(DISTINCT stay_id) AS dup FROM d),
p AS (SELECT count(*) AS pairs FROM ({' UNION ALL '.join(f"SELECT corr({a}, {b}) AS c FROM d" for i, a in enumerate(_PR) for b in _PR[i + 1:])}) WHERE abs(c) > 0.8),
k AS (SELECT {' + '.join(f'(min({c}) = max({c}))::INTEGER' for c in _PR)} AS constants FROM d),
w AS (SELECT *, (dup > 0)::INTEGER + constants + (len(list_filter(m, lambda x: x > 0.5 * n)) > 0)::INTEGER
  + (rate < 0.05 OR rate > 0.5)::INTEGER + (pairs > 5)::INTEGER AS n_warnings FROM m, p, k)
SELECT n_warnings::BIGINT AS n_warnings, (rate < 0.001)::BIGINT AS n_errors,
  greatest(round(100.0::DOUBLE - least(0.5::DOUBLE * 100 * list_sum(m) / (n * 7), 20.0::DOUBLE) - 2 * n_warnings - 10 * (rate < 0.001)::INTEGER
    - CASE WHEN rate < 0.01 THEN 10 WHEN rate < 0.05 THEN 5 ELSE 0 END, 1), 0.0::DOUBLE) AS quality_score FROM w"""))
def quality_score(t):
    df = profiled(t).select("stay_id", *_PR, "flag", "y")
    return P.quality_report(df, columns=_PR)["score"]


_TXT = ("flag", "quantity_text")


def _text_summary(c: str) -> str:
    num = f"try_cast({c} AS DOUBLE)"
    ok = f"(count({num}) > 0 AND count({num}) >= 0.5 * count({c}))"
    top = (f"(SELECT string_agg(v || '(' || n || ')', '; ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM d GROUP BY 1 "
           f"ORDER BY n DESC, v LIMIT 3))")
    top = top if c in _TXT else "NULL"
    return (f"SELECT '{c}' AS column_name, {int(c in _TXT)} AS is_text, count(*) - count({c}) AS n_missing, "
            f"100.0::DOUBLE * (count(*) - count({c})) / count(*) AS pct_missing, {ok}::INTEGER AS is_numeric, "
            + ", ".join(f"CASE WHEN {ok} THEN {f}({num}) END AS {n}" for n, f in
                        (("min_value", "min"), ("max_value", "max"), ("mean_value", "avg"), ("std_value", "stddev_samp")))
            + f", CASE WHEN {ok} THEN corr({num}, y) END AS corr_with_y, count(DISTINCT {c}) AS n_unique, "
            f"CASE WHEN {ok} THEN quantile_cont({num}, 0.5) END AS median_value, {top} AS top_values FROM d")


_FS = ("quantity", "discount", "line", *_TXT)


@query("feature_summary", q(r6(_D + " UNION ALL ".join(_text_summary(c) for c in _FS),
                               "pct_missing min_value max_value mean_value std_value corr_with_y median_value")))
def feature_summary(t):
    df = profiled(t).select(*_FS, "y")
    return rounded(P.feature_summary(df).where(F.col("column_name") != "y"))


@query("histogram", q(_D + """
SELECT (CASE WHEN price < 0 THEN 0 WHEN price >= 100000 THEN 21 ELSE floor(price / 5000) + 1 END)::BIGINT AS bin, count(*) AS n FROM d GROUP BY 1"""))
def histogram(t):
    return P.histogram(profiled(t), "price", 0, 100000, 20)


@query("group_quantiles", q(r6("""
SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50,
       quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1""", "p10 p50 p90")))
def group_quantiles(t):
    freq = t.read("lineitem", "l_returnflag", "l_extendedprice").groupBy(
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.exact_quantiles(freq, ["flag"], "value", "n", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


# --- sampling and folds ------------------------------------------------------------------

_HASH = "md5({c}::VARCHAR || ':{s}')"
_INT = "('0x' || substr(md5({c}::VARCHAR || ':{s}'), 1, 8))::BIGINT"


def orders_labelled(t) -> DataFrame:
    return t.read("orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )


_OL = "SELECT o_orderkey AS stay_id, o_custkey AS subject_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders"


@query("hash_sample", f"SELECT * FROM ({_OL}) ORDER BY {_HASH.format(c='stay_id', s=42)}, stay_id LIMIT 500")
def hash_sample(t):
    return V.sample(orders_labelled(t), "stay_id", 500)


@query("stratified_sample", f"""
WITH o AS ({_OL}), c AS (SELECT y, floor(500.0::DOUBLE * count(*) / (SELECT count(*) FROM o) + 0.5::DOUBLE) AS quota FROM o GROUP BY y)
SELECT stay_id, subject_id, y FROM (SELECT o.*, c.quota, row_number() OVER (PARTITION BY o.y ORDER BY {_HASH.format(c='stay_id', s=42)}, stay_id) AS rn
FROM o JOIN c ON c.y = o.y) WHERE rn <= quota""")
def stratified_sample(t):
    return V.stratified_sample(orders_labelled(t), "stay_id", "y", 500)


@query("stratified_folds", f"""
SELECT stay_id, ((row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(c='stay_id', s=42)}, stay_id) - 1) % 5)::INTEGER AS fold FROM ({_OL})""")
def stratified_folds(t):
    return V.stratified_folds(orders_labelled(t), "stay_id", "y")


@query("group_folds", f"SELECT stay_id, subject_id, ({_INT.format(c='subject_id', s=42)} % 5)::INTEGER AS fold FROM ({_OL})")
def group_folds(t):
    return orders_labelled(t).select("stay_id", "subject_id", V.group_fold("subject_id").alias("fold"))


@query("group_split", f"""
SELECT ({_INT.format(c='subject_id', s=42)} / 4294967296.0::DOUBLE < 0.2)::INTEGER AS is_test, count(*) AS n,
       count(DISTINCT subject_id) AS n_subjects FROM ({_OL}) GROUP BY 1""")
def group_split(t):
    return orders_labelled(t).groupBy(V.in_test("subject_id").cast("int").alias("is_test")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subject_id").alias("n_subjects")
    )


@query("shuffled_labels", f"""
WITH o AS ({_OL}), a AS (SELECT stay_id, row_number() OVER (ORDER BY stay_id) AS p FROM o),
b AS (SELECT y, row_number() OVER (ORDER BY {_HASH.format(c='stay_id', s=43)}, stay_id) AS p FROM o)
SELECT a.stay_id, b.y FROM a JOIN b ON a.p = b.p""")
def shuffled_labels(t):
    return V.shuffled_labels(orders_labelled(t), "stay_id", "y")


# --- metrics -----------------------------------------------------------------------------

_SCORED = """
SELECT l.doc_id, l.doc_id % 50 AS subject_id, d.lang, l.quality AS y, l.toxic, (d.n_chars % 97) / 97.0::DOUBLE AS score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


def scored(t) -> DataFrame:
    l = t.read("labels")
    d = t.read("documents", "doc_id", "lang", "n_chars")
    return l.join(d, "doc_id").select(
        "doc_id", (F.col("doc_id") % 50).alias("subject_id"), "lang", F.col("quality").alias("y"), "toxic",
        (F.col("n_chars") % 97 / F.lit(97.0)).alias("score"),
    )


# "labels" is a given table here, not the label grid: the parts below bypass the WITH helper.
_RANK = """
SELECT {g}, sum(y)::DOUBLE AS n_pos, sum(1 - y)::DOUBLE AS n_neg,
  (sum(CASE WHEN y = 1 THEN below + 0.5::DOUBLE * same END)) / nullif(sum(y) * sum(1 - y), 0) AS auroc,
  coalesce(sum(CASE WHEN y = 1 THEN pos_ge / all_ge END) / nullif(sum(y), 0), 0) AS average_precision
FROM (SELECT s.*, (SELECT count(*) FROM s o WHERE o.y = 0 AND {on} AND o.score < s.score)::DOUBLE AS below,
        (SELECT count(*) FROM s o WHERE o.y = 0 AND {on} AND o.score = s.score)::DOUBLE AS same,
        (SELECT count(*) FROM s o WHERE o.y = 1 AND {on} AND o.score >= s.score)::DOUBLE AS pos_ge,
        (SELECT count(*) FROM s o WHERE {on} AND o.score >= s.score)::DOUBLE AS all_ge FROM s) GROUP BY ALL"""
_S = f"WITH s AS ({_SCORED}) "


@query("auroc", r6(_S + "SELECT n_pos, n_neg, auroc FROM (" + _RANK.format(g="1 AS one", on="TRUE") + ")", "n_pos n_neg auroc"))
def auroc(t):
    return rounded(V.ranking_metrics(scored(t), "score", "y").select("n_pos", "n_neg", "auroc"))


@query("average_precision", r6(_S + "SELECT n_pos, n_neg, average_precision FROM (" + _RANK.format(g="1 AS one", on="TRUE") + ")",
                               "n_pos n_neg average_precision"))
def average_precision(t):
    return rounded(V.ranking_metrics(scored(t), "score", "y").select("n_pos", "n_neg", "average_precision"))


@query("ranking_metrics_by_group", r6(_S + _RANK.format(g="lang", on="o.lang = s.lang"), "n_pos n_neg auroc average_precision"))
def ranking_metrics_by_group(t):
    return rounded(V.ranking_metrics(scored(t), "score", "y", ["lang"]))


_CONF = """count(*) AS n, 0::BIGINT AS n_left_out, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, avg((score - y) * (score - y)) AS brier"""


@query("brier_threshold_metrics", r6(_S + f"""
SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity
FROM (SELECT lang, {_CONF} FROM s GROUP BY lang)""", "brier precision recall f1 specificity"))
def brier_threshold_metrics(t):
    return rounded(V.threshold_metrics(scored(t), "score", "y", ["lang"]))


@query("fold_summary", r6(_S + f"""
SELECT avg(auroc) AS auroc_mean, stddev_pop(auroc) AS auroc_std, min(auroc) AS auroc_min, max(auroc) AS auroc_max, count(*) AS n_folds
FROM ({_RANK.format(g='lang', on='o.lang = s.lang')})""", "auroc_mean auroc_std auroc_min auroc_max"))
def fold_summary(t):
    return rounded(V.fold_summary(V.ranking_metrics(scored(t), "score", "y", ["lang"]), ["auroc"]))


@query("kappa_confusion", r6(_S + """
SELECT n11, n10, n01, n00, (n11 + n10)::DOUBLE / n AS prevalence_a, (n11 + n01)::DOUBLE / n AS prevalence_b,
  (n11 + n01)::DOUBLE / n - (n11 + n10)::DOUBLE / n AS delta,
  ((n11 + n00)::DOUBLE / n - chance) / (1 - chance) AS kappa
FROM (SELECT *, ((n11 + n10)::DOUBLE * (n11 + n01) + (n01 + n00)::DOUBLE * (n10 + n00)) / (n::DOUBLE * n) AS chance FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND toxic = 1) AS n11, count(*) FILTER (WHERE y = 1 AND toxic = 0) AS n10,
  count(*) FILTER (WHERE y = 0 AND toxic = 1) AS n01, count(*) FILTER (WHERE y = 0 AND toxic = 0) AS n00 FROM s))""",
    "prevalence_a prevalence_b delta kappa"))
def kappa_confusion(t):
    return rounded(V.kappa(scored(t), "y", "toxic"))


@query("confusion_matrix", _S + "SELECT y, toxic, count(*) AS n FROM s GROUP BY 1, 2")
def confusion_matrix(t):
    return V.confusion(scored(t), "y", "toxic")


_B = 1000
_U = "(('0x' || substr(md5(subject_id::VARCHAR || ':' || r::VARCHAR || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_W = " + ".join(f"({_U} >= {c}::DOUBLE)::INTEGER" for c in V.POISSON_1_CDF)
_BOOT = f"""
WITH s AS ({_SCORED}), x AS (SELECT s.*, r, {_W} AS w FROM s, range(1, {_B + 1}) t(r)),
v AS (SELECT r, score, sum(w * y)::DOUBLE AS p, sum(w * (1 - y))::DOUBLE AS n FROM x WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY r) AS tp, sum(n) OVER (PARTITION BY r) AS tn,
  sum(p) OVER (PARTITION BY r ORDER BY score DESC) AS pge, sum(n) OVER (PARTITION BY r ORDER BY score DESC) AS nge FROM v),
m AS (SELECT r, sum(p * (below + 0.5::DOUBLE * n)) / nullif(max(tp) * max(tn), 0) AS auroc,
  coalesce(sum(p * pge / (pge + nge)) / nullif(max(tp), 0), 0) AS average_precision FROM c GROUP BY 1),
pt AS ({_RANK.format(g='1 AS one', on='TRUE')})
SELECT 'auroc' AS metric, (SELECT auroc FROM pt) AS point, quantile_cont(auroc, 0.025) AS low, quantile_cont(auroc, 0.975) AS high FROM m
UNION ALL SELECT 'average_precision', (SELECT average_precision FROM pt), quantile_cont(average_precision, 0.025),
  quantile_cont(average_precision, 0.975) FROM m"""


@query("bootstrap_ci", r6(_BOOT, "point low high"))
def bootstrap_ci(t):
    return rounded(V.bootstrap_ci(scored(t), "subject_id", "score", "y", replicates=_B))


@query("missingness_delta", q(r6(_D + _each("""
SELECT '{c}' AS column_name, 100.0::DOUBLE * avg(CASE WHEN status = 'F' THEN ({c} IS NULL)::INTEGER END) AS pct_a,
  100.0::DOUBLE * avg(CASE WHEN status = 'O' THEN ({c} IS NULL)::INTEGER END) AS pct_b,
  100.0::DOUBLE * avg(CASE WHEN status = 'O' THEN ({c} IS NULL)::INTEGER END) - 100.0::DOUBLE * avg(CASE WHEN status = 'F' THEN ({c} IS NULL)::INTEGER END) AS delta
FROM d""", ("discount", "tax", "line")), "pct_a pct_b delta")))
def missingness_delta(t):
    df = profiled(t)
    return rounded(V.missingness_delta(df.where("status = 'F'"), df.where("status = 'O'"), ["discount", "tax", "line"]))
