"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# All of these are runtime SQL settings, so they can be applied to a session
# that somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot stay or admission is split even when the join feeds an aggregate on
    # the same key; the price is one more exchange of already reduced rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that a Python worker and the buffer before it hold at once; texts may be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and return the session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the session's own setting wins.

    Only a local session without any setting gets a temporary folder; on a
    cluster a folder on one machine would not outlive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to the shared folder and read back: one fixed version of the rows.

    Cuts the lineage like a checkpoint, and keeps column pruning, filter pushdown
    and known sizes for everything downstream.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
