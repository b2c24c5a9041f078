"""Source tables with declared schemas, and readers for Parquet, CSV and JDBC."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The columns the operators read. Sources may carry more; only these are kept.
SCHEMAS = {
    "stays": "subject_id bigint, stay_id bigint, hadm_id bigint, intime timestamp_ntz, outtime timestamp_ntz,"
             " arrival_transport string, disposition string, race string",
    "persons": "subject_id bigint, anchor_age int, anchor_year int, gender string, dod date",
    "triage": "stay_id bigint, temperature double, heartrate double, resprate double, o2sat double, sbp double,"
              " dbp double, pain string, acuity int, chiefcomplaint string",
    "vitals": "stay_id bigint, charttime timestamp_ntz, temperature double, heartrate double, resprate double,"
              " o2sat double, sbp double, dbp double",
    "medications": "stay_id bigint, charttime timestamp_ntz",
    "admissions": "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, deathtime timestamp_ntz",
    "lab_items": "itemid bigint, label string",
    "labs": "subject_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, valuenum double",
    "diagnosis_codes": "icd_code string, icd_version int, long_title string",
    "diagnoses": "subject_id bigint, hadm_id bigint, icd_code string, icd_version int",
    "procedure_codes": "icd_code string, icd_version int, long_title string",
    "procedures": "subject_id bigint, hadm_id bigint, icd_code string, icd_version int",
    "unit_stays": "hadm_id bigint, intime timestamp_ntz, first_careunit string",
    "items": "itemid bigint, label string",
    "inputs": "subject_id bigint, hadm_id bigint, starttime timestamp_ntz, itemid bigint, amount double",
    "procedure_events": "subject_id bigint, hadm_id bigint, starttime timestamp_ntz, itemid bigint",
    "chart_events": "subject_id bigint, hadm_id bigint, charttime timestamp_ntz, itemid bigint, value string",
    "ecg_studies": "subject_id bigint, study_id bigint, file_name string, ecg_time timestamp_ntz, path string",
    "ecg_measurements": "subject_id bigint, study_id bigint, rr_interval float, p_onset float, p_end float,"
                        " qrs_onset float, qrs_end float, t_end float, p_axis float, qrs_axis float, t_axis float",
}


@dataclass(frozen=True)
class Sources:
    """The nineteen source tables as DataFrames."""

    stays: DataFrame
    persons: DataFrame
    triage: DataFrame
    vitals: DataFrame
    medications: DataFrame
    admissions: DataFrame
    lab_items: DataFrame
    labs: DataFrame
    diagnosis_codes: DataFrame
    diagnoses: DataFrame
    procedure_codes: DataFrame
    procedures: DataFrame
    unit_stays: DataFrame
    items: DataFrame
    inputs: DataFrame
    procedure_events: DataFrame
    chart_events: DataFrame
    ecg_studies: DataFrame
    ecg_measurements: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Keep the declared columns, cast to the declared types; a missing column is an error."""
    declared = [c.split() for c in SCHEMAS[table].split(",")]
    return df.selectExpr(*[f"CAST({name} AS {kind}) AS {name}" for name, kind in declared])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, columns: list[str] | None = None
) -> DataFrame:
    """CSV with a header row and a declared schema (nothing is inferred)."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 64, properties: dict | None = None,
) -> DataFrame:
    """Table of a relational database, split on a numeric key so that executors read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if key:
        if not bounds:
            raise ValueError("a partitioned JDBC read needs the key bounds")
        reader = (reader.option("partitionColumn", key).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", partitions))
    return reader.load()


def load_sources(spark: SparkSession, base: str, fmt: str = "parquet") -> Sources:
    """All source tables from ``<base>/<table>`` in Parquet or CSV."""
    if fmt == "parquet":
        read = lambda t: read_parquet(spark, f"{base}/{t}")
    elif fmt == "csv":
        read = lambda t: read_csv(spark, f"{base}/{t}", schema_of(t))
    else:
        raise ValueError(f"unknown source format {fmt!r}")
    return Sources(**{t: conform(read(t), t) for t in SCHEMAS})
