"""Queries of sources, sinks and inspection: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.session import checkpoint_dir, materialize
from tidemark.operators import dataset as D
from tidemark.operators import profile as P
from tidemark.operators.features import baskets_from
from tidemark.plans.oracle import q, r6
from tidemark.plans.presets import EXPERIMENTS
from tidemark.plans.registry import query, rounded
from tidemark.sources import inspect, sinks
from tidemark.sources.tables import read_csv


def _folder(t) -> str:
    return f"{checkpoint_dir(t.spark)}/export-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT c_custkey, c_acctbal, c_name FROM customer")
def csv_round_trip(t):
    path = _folder(t)
    sinks.write_csv(t.read("customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path, "c_custkey")
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return read_csv(t.spark, path, schema, ["c_custkey", "c_acctbal", "c_name"])


@query("table_replaced", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def table_replaced(t):
    path, orders = _folder(t), t.read("orders", "o_orderkey", "o_orderstatus")
    sinks.write_table(orders, path)
    stored = sinks.write_table(orders.where("o_orderstatus <> 'P'"), path)
    return stored.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("repeated_append", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def repeated_append(t):
    path, events = _folder(t), t.read("events", "event_id", "event_type", "value")
    for types in (["view", "click"], ["error", "purchase", "signup"], ["view", "click"], ["click"]):  # the last two repeat what is there
        sinks.replace_partitions(events.where(F.col("event_type").isin(types)), path, ["event_type"])
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("appended_rows", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def appended_rows(t):
    path, events = _folder(t), t.read("events", "user_id", "event_type")
    for part in (events.where("event_type = 'view'"), events.where("event_type <> 'view'")):
        sinks.append_table(part, path)
    return t.spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("derived_column", "SELECT CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'small' END AS size_class, "
                         "count(*) AS n FROM orders GROUP BY 1")
def derived_column(t):
    price = F.col("o_totalprice")
    stored = sinks.write_table(t.read("orders", "o_orderkey", "o_totalprice"), _folder(t))
    size = F.when(price >= 200000, "large").when(price >= 100000, "middle").otherwise("small")
    return sinks.add_column(stored, _folder(t), "size_class", size).groupBy("size_class").agg(F.count(F.lit(1)).alias("n"))


@query("json_report", r6("SELECT l_returnflag, count(*) AS n, avg(l_discount) AS discount FROM lineitem GROUP BY 1", "discount"))
def json_report(t):
    path = _folder(t)
    found = t.read("lineitem", "l_returnflag", "l_discount").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("discount"))
    sinks.write_report({"discounts": found}, path)
    return rounded(t.spark.read.schema("l_returnflag string, n long, discount double").json(f"{path}/discounts"))


@query("column_listing", """
SELECT (row_number() OVER ())::INT AS ordinal, column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE 'double' END AS data_type
FROM (DESCRIBE SELECT * FROM lineitem) QUALIFY column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')""")
def column_listing(t):
    return inspect.columns_of(t.spark, t.read("lineitem"), ["bigint", "int", "double"])


@query("column_contract", """
WITH e AS (SELECT unnest(['event_id', 'user_id', 'amount', 'ts']) AS column_name), a AS (SELECT column_name FROM (DESCRIBE SELECT * FROM events))
SELECT column_name, 'missing' AS status FROM e WHERE column_name NOT IN (SELECT column_name FROM a)
UNION ALL SELECT column_name, 'extra' FROM a WHERE column_name NOT IN (SELECT column_name FROM e)""")
def column_contract(t):
    return inspect.contract_diff(t.spark, t.read("events"), ["event_id", "user_id", "amount", "ts"])


@query("sample_preview", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 2")
def sample_preview(t):
    return inspect.preview(t.read("orders", "o_orderkey", "o_custkey").orderBy("o_orderkey"))


@query("top_correlations", r6("""
WITH c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS column_name,
  unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), corr(l_tax, l_extendedprice), corr(l_linenumber, l_extendedprice)]) AS correlation FROM lineitem)
SELECT * FROM c ORDER BY abs(correlation) DESC, column_name LIMIT 2""", "correlation"))
def top_correlations(t):
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return rounded(P.correlations_with(t.read("lineitem", "l_extendedprice", *columns), "l_extendedprice", columns, top=2))


_BATCH = {n: s for n, s in EXPERIMENTS.items() if not s.include_ecg}


def _batch_sql() -> str:
    parts = []
    for name, s in _BATCH.items():
        plain = f"ed_{s.windows[0].lower()}_{s.outcomes[0]}_{s.cohort}"
        only = "WHERE b.hadm_id IS NOT NULL" if s.cohort == "admitted" else ""
        parts.append(f"SELECT '{name}' AS dataset, '{plain}' AS plain_name, count(*) AS n_rows, coalesce(sum(o.{s.outcomes[0]}), 0)::BIGINT AS n_positive "
                     f"FROM cohort b JOIN labels o USING (stay_id) {only}")
    return " UNION ALL ".join(parts)


@query("dataset_batch", q(_batch_sql()))
def dataset_batch(t):
    specs = list(_BATCH.values())
    standard = [R.W1, R.W6, R.W24]
    # stage tables: every dataset of the batch starts from them
    wide, labels = materialize(t.features(*standard)), materialize(t.labels)
    frames = {s.windows: baskets_from(wide, standard, [R.WINDOWS[w] for w in s.windows]) for s in specs}
    built = D.assemble_all(t.staged, frames, labels, specs)
    counts = [df.agg(F.lit(n).alias("dataset"), F.lit(D.dataset_name(s.windows, s.outcomes, s.cohort)).alias("plain_name"), F.count(F.lit(1)).alias("n_rows"),
                     F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("n_positive")) for (n, df), s in zip(built.items(), specs, strict=True)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
