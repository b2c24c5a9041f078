"""Registry of runnable queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.functions.session import materialize, tune
from tidemark.operators.cohort import build_cohort
from tidemark.operators.ecg import build_ecg_features
from tidemark.operators.events import build_event_log
from tidemark.operators.features import build_features
from tidemark.operators.labels import build_labels
from tidemark.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Tables`` under a name."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns so that results compare across engines (and drop negative zero)."""
    return df.select(*[
        (F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ])


class Tables:
    """Lazily built inputs of one query: given tables, bound sources, stage frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def read(self, table: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return df.select(*columns) if columns else df

    @cached_property
    def src(self):
        return B.events_sources(self.spark, self.sf_dir)

    @cached_property
    def cohort(self) -> DataFrame:
        stays, persons = B.stays_and_persons(self.spark, self.sf_dir)
        return build_cohort(stays, persons)

    @cached_property
    def staged(self) -> DataFrame:
        """The cohort as a stage table: every extractor and basket starts from it."""
        return materialize(self.cohort)

    @cached_property
    def events(self) -> DataFrame:
        """The event log as a stage table: labels and checks read it again."""
        return materialize(build_event_log(self.staged, self.src))

    @cached_property
    def labels(self) -> DataFrame:
        return build_labels(self.staged, self.events)

    def features(self, *specs: R.WindowSpec, **kw) -> DataFrame:
        return build_features(self.staged, self.src, specs, hs_items=B.HS_ITEMS, **kw)

    def ecg(self, hours: float, window: str) -> DataFrame:
        # ECGs know only their subject, so no assignment to stays is needed
        studies, measures = B.ecg_tables(B.raw_events(self.spark, self.sf_dir))
        return build_ecg_features(self.cohort, studies, measures, hours, window)
