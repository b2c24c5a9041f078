import pytest
from pyspark.sql import functions as F

from tidemark.sources import inspect as I
from tidemark.sources import sinks as S
from tidemark.sources import tables as T
from tests.helpers import h, sources, stay


def test_parquet_and_csv_round_trip(spark, tmp_path):
    src = sources(spark, stays=[stay(1, 1, None), stay(2, 1, 7)], vitals=[{"stay_id": 1, "charttime": h(1), "sbp": 101.5}])
    for name, df in src.tables().items():
        df.write.parquet(str(tmp_path / "p" / name))
        df.write.option("header", True).csv(str(tmp_path / "c" / name))
    for fmt, base in (("parquet", "p"), ("csv", "c")):
        back = T.load_sources(spark, str(tmp_path / base), fmt)
        for name, df in back.tables().items():
            assert df.dtypes == getattr(src, name).dtypes, name
        assert sorted(map(str, back.stays.collect())) == sorted(map(str, src.stays.collect()))
        assert back.vitals.first().charttime == h(1)
    with pytest.raises(ValueError):
        T.load_sources(spark, str(tmp_path), "xml")


def test_column_subset_is_pruned_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(path)
    df = T.read_parquet(spark, path, ["b"])
    assert "ReadSchema: struct<b:bigint>" in df._jdf.queryExecution().toString()


def test_missing_source_column_is_an_error(spark):
    with pytest.raises(Exception, match="charttime"):
        T.conform(spark.createDataFrame([(1,)], "stay_id long"), "medications").collect()


def test_jdbc_split_needs_bounds(spark):
    with pytest.raises(ValueError):
        T.read_jdbc(spark, "jdbc:none:", "t", key="id")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "stay_id int, v string")
    back = S.write_table(df, str(tmp_path / "t"))
    assert back.count() == 2 and S.write_table(df.limit(1), str(tmp_path / "t")).count() == 1
    S.append_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    S.write_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert text.index("1,a") < text.index("2,b") and "stay_id,v" in text
    S.write_report({"a": df}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "a")).count() == 2
    assert "w" in S.add_column(df, str(tmp_path / "n"), "w", F.lit(1)).columns


def test_bucketed_join_needs_no_exchange(spark):
    df = spark.range(100).withColumnRenamed("id", "stay_id")
    S.save_bucketed(df, "b_left", "stay_id", 4)
    S.save_bucketed(df.withColumn("v", F.lit(1)), "b_right", "stay_id", 4)
    hint = spark.table("b_left").hint("merge").join(spark.table("b_right"), "stay_id")
    assert "Exchange" not in hint._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE b_left"), spark.sql("DROP TABLE b_right")


def test_inspection(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "stay_id int, v string, x double")
    assert [(r.ordinal, r.column_name) for r in I.columns_of(spark, df, ["int", "double"]).collect()] == [(1, "stay_id"), (3, "x")]
    diff = {(r.column_name, r.status) for r in I.contract_diff(spark, df, ["stay_id", "y"]).collect()}
    assert diff == {("y", "missing"), ("v", "extra"), ("x", "extra")}
    assert {r.table_name: r.n_rows for r in I.row_counts({"a": df, "b": df.limit(0)}).collect()} == {"a": 1, "b": 0}
    assert I.preview(df).count() == 1
