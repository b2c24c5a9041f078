"""Hand-written source tables: pass the rows a test needs, the others stay empty."""

from datetime import datetime, timedelta

from pyspark.sql.types import StructType

from tidemark.sources.tables import SCHEMAS, Sources, schema_of

T0 = datetime(2024, 1, 10, 8, 0)
US = timedelta(microseconds=1)


def h(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


def table(spark, name, rows=()):
    schema: StructType = schema_of(name)
    names = [f.name for f in schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def sources(spark, **rows) -> Sources:
    return Sources(**{name: table(spark, name, rows.get(name, ())) for name in SCHEMAS})


def stay(stay_id=1, subject_id=1, hadm_id=100, intime=T0, outtime=None, **kw):
    return {"stay_id": stay_id, "subject_id": subject_id, "hadm_id": hadm_id, "intime": intime,
            "outtime": outtime or intime + timedelta(hours=12), **kw}


def person(subject_id=1, anchor_age=50, anchor_year=2024, gender="F", dod=None):
    return {"subject_id": subject_id, "anchor_age": anchor_age, "anchor_year": anchor_year, "gender": gender, "dod": dod}


def by_key(df, key="stay_id"):
    return {r[key]: r for r in df.collect()}
