"""Exact deduplication against immutable snapshots, screened by binary fuse filters.

A snapshot holds the digests of all texts accepted so far: exact buckets and
one static filter per bucket. A new batch is first grouped by itself, its
distinct digests are screened by the filters, and only the positives are
joined to the exact buckets, where the bytes of the two texts are compared; where they
agree the batch's group joins the snapshot's. A digest that the filters deny is new, nothing
else is asked about it. New groups become a snapshot of their own; older ones are never changed.

Defined results: NULL text counts as empty; empty texts are equal to each
other. NULL ids order last. Of repeated rows (same id, same text) one is kept.
An empty table gives an empty result. Extra columns are not looked at, so their
names may clash with any used here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import materialize
from tidemark.llm import fuse
from tidemark.llm.columns import join_null_safe, whole_text, without_space

#: rows per bucket aimed at: what one task builds a filter from, or screens
BUCKET_ROWS = 1 << 15
_FILTER = "bucket int, seed int, segment int, starts long, slots binary"


@dataclass(frozen=True)
class Snapshot:
    """Digests with their best row (``exact``) and one filter per bucket (``filters``), both written tables."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, code points, digest of the text without white space."""
    text = whole_text("text")
    return docs.select(
        "doc_id", F.length(text).cast("long").alias("n_points"), F.sha2(without_space(text), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _best() -> F.Column:
    """Most code points, then smallest id; the row number only tells repeated rows apart."""
    return F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.hash("text_sha256"), F.lit(buckets)).alias("bucket")


def _build(rows: pa.Table) -> pa.Table:
    f = fuse.build(rows["key"].to_numpy())
    return pa.table({
        "bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()), "seed": pa.array([f.seed], pa.int32()),
        "segment": pa.array([f.segment], pa.int32()), "starts": pa.array([f.starts], pa.int64()),
        "slots": pa.array([f.slots], pa.binary()),
    })


def make_snapshot(groups: DataFrame, buckets: int) -> Snapshot:
    """Fix the distinct digests of ``groups`` (``text_sha256``, ``best``) as a snapshot."""
    exact = materialize(groups.select("text_sha256", F.col("best.doc_id").alias("snap_id")))
    keys = exact.select(_bucket(buckets), F.xxhash64("text_sha256").alias("key"))
    return Snapshot(exact, materialize(keys.groupBy("bucket").applyInArrow(_build, _FILTER)), buckets)


def _screen(batch: pa.Table, filters: pa.Table) -> pa.Table:
    keys = batch["text_sha256"]
    if not len(filters) or not len(batch):
        return pa.table({"text_sha256": keys.slice(0, 0)})
    f = filters.to_pylist()[0]
    hit = fuse.FuseFilter(f["seed"], f["segment"], f["starts"], f["slots"]).contains(batch["key"].to_numpy())
    return pa.table({"text_sha256": keys.filter(pa.array(hit))})


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Digests of the batch that the snapshot may hold: all that it holds and a few false positives."""
    keys = groups.select(_bucket(snapshot.buckets), F.xxhash64("text_sha256").alias("key"), "text_sha256")
    return keys.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(_screen, "text_sha256 string")


def same_bytes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of (``text_sha256``, ``snap_id``, ``batch_id``) those whose two texts have the same bytes."""
    ids = pairs.select("text_sha256", F.explode(F.array_distinct(F.array("snap_id", "batch_id"))).alias("at"))
    texts = docs.select("doc_id", without_space(whole_text("text")).alias("bare"))
    # at scale the ids fit no broadcast, so the plan is the shuffle join at every size
    fetched = join_null_safe(texts, ids.hint("merge"), {"doc_id": "at"}).where(F.sha2("bare", 256) == F.col("text_sha256"))
    return fetched.groupBy("text_sha256").agg(F.min("bare").alias("lo"), F.max("bare").alias("hi")).where("lo = hi").select("text_sha256")


def deduplicate(docs: DataFrame, batches: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every document with the row of its group that stays.

    The table is taken in as ``batches`` batches (by a hash of the id); each is
    screened against the snapshots of those before it. Columns: ``doc_id``,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_points``.
    """
    rows = materialize(digests(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")))
    buckets = max(1, -(-rows.count() // (batches * bucket_rows)))
    snapshots: list[Snapshot] = []
    groups: list[DataFrame] = []
    for b in range(batches):
        # partial aggregation on the map side: a group of copies travels as one row per task
        own = materialize(rows.where(F.col("batch") == b).groupBy("text_sha256").agg(_best().alias("best"), F.count(F.lit(1)).alias("n")))
        # the batch whose snapshot holds the text; a group that no filter admits, or whose bytes differ, is at home in its own
        home = F.lit(b)
        if snapshots:
            own, home = own.join(_known(own, snapshots, docs), "text_sha256", "left"), F.coalesce("home", F.lit(b))
        own = own.withColumn("home", home)
        groups.append(own.withColumn("batch", F.lit(b)))
        if b + 1 < batches:
            snapshots.append(make_snapshot(own.where(F.col("home") == b), buckets))
    ledger = reduce(DataFrame.unionByName, groups)
    final = ledger.groupBy("text_sha256", "home").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    # written, so that the join below is a plain shuffle of both sides and a hot group can be split
    of_batch = materialize(ledger.select("text_sha256", "batch", "home").join(final, ["text_sha256", "home"]).drop("home"))
    out = rows.join(of_batch, ["text_sha256", "batch"])
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256", "n_points",
    )


def _known(own: DataFrame, snapshots: list[Snapshot], docs: DataFrame) -> DataFrame:
    """Digests of the batch whose text a snapshot holds, and the first such snapshot (``home``)."""
    found = []
    for home, snapshot in enumerate(snapshots):
        positive = screen(own, snapshot).join(snapshot.exact, "text_sha256")
        pairs = materialize(positive.join(own.select("text_sha256", F.col("best.doc_id").alias("batch_id")), "text_sha256"))
        found.append(same_bytes(pairs, docs).withColumn("home", F.lit(home)))
    return reduce(DataFrame.unionByName, found).groupBy("text_sha256").agg(F.min("home").alias("home"))


def kept_documents(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    stay = decisions.where("kept").select(F.col("doc_id").alias("_stay_id"), F.col("text_sha256").alias("_stay_sha"), F.col("n_points").alias("_stay_points"))
    digest = F.sha2(without_space(whole_text("text")), 256)
    tagged = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay_id"))).where(digest == F.col("_stay_sha"))
    # rows that share an id may differ in white space: the one with the code points of the row that stays
    tagged = tagged.where(F.length(whole_text("text")) == F.col("_stay_points"))
    repeated = decisions.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (tagged.dropDuplicates(["doc_id", "_stay_sha"]) if repeated else tagged).drop("_stay_id", "_stay_sha", "_stay_points")
