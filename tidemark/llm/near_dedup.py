"""Near-duplicate documents by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every document gets its set of five-word shingles and a MinHash signature.
   Equal sets collapse to one node; copies are never paired with each other.
2. Nodes are posted under each (coordinate, value) pair. Two nodes with a
   similarity of 0.75 agree in fewer than ``MATCHES`` of ``COORDINATES`` with a
   probability below 1e-8, so a value that no other node has is of no use, and a
   node with fewer than ``MATCHES`` shared values has no partner at all.
3. For what is left, shingles shared with any other node are counted. This
   count bounds every overlap (``|x and y| <= shared(x)``), and skips pairs before
   they are looked at.
4. Prefix: ordered by rarity, two nodes that agree in ``MATCHES`` values meet in a
   list of their first ``values - MATCHES + 1``. Each list is joined to its most
   central node only, which links a large group around its original without
   forming its pairs.
5. Nodes of different components that may still be linked meet on their rarest
   shingles, in a prefix as long as their sizes demand; lists within one
   component are skipped, and so is the largest component of a list on one side.
6. Pairs above the match threshold are confirmed on their full sets; components
   of the confirmed links are the groups.

Defined results: NULL text counts as empty; a document without words has no
shingles and is alone. A NULL id is a document; component ids skip NULL where
there is another. Repeated rows fall into one group and get equal rows. An
empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import materialize
from tidemark.llm import text as X
from tidemark.llm.columns import join_null_safe
from tidemark.llm.components import components

WIDTH = 5
COORDINATES = 64
#: P(Binomial(64, 0.75) < 28) is below 1e-8
MATCHES = 28
#: sizes are put into classes of this ratio for the last join
CLASS_RATIO = 1.15

_RNG = np.random.Generator(np.random.PCG64(7))
_FLIP = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)


def signature(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per non-empty set its (coordinate, value) pairs: six bits of coordinate, 58 of the least hash."""
    out = np.empty((len(first) - 1, COORDINATES), np.uint64)
    for k in range(COORDINATES):
        least = np.minimum.reduceat((values ^ _FLIP[k]) * _TIMES[k], first[:-1])
        out[:, k] = (np.uint64(k) << np.uint64(58)) | (least >> np.uint64(6))
    return out


def _fingerprint(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that are equal for equal sets."""
    a = np.add.reduceat(X.mix(values + np.uint64(1)), first[:-1])
    b = np.add.reduceat(X.mix(values ^ _FLIP[0]), first[:-1])
    flat = np.stack([a, b], axis=1).tobytes()
    return [flat[i: i + 16] for i in range(0, len(flat), 16)]


def _sets(table_text: pa.ChunkedArray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts: rows, which of them have shingles, the shingles, first index per such row (one more)."""
    for rows, data, offsets in X.chunks(table_text):
        values, first = X.shingles(*X.word_hashes(data, offsets), WIDTH)
        some = np.flatnonzero(np.diff(first) > 0)
        yield rows, some, values, np.append(first[some], len(values))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, some, values, first in _sets(batch.column("text")):
            n = np.zeros(rows.stop - rows.start, np.int64)
            n[some] = np.diff(first)
            mark: list[bytes | None] = [None] * len(n)
            sig: list[np.ndarray | None] = [None] * len(n)
            if len(some):
                for i, m, s in zip(some, _fingerprint(values, first), signature(values, first).view(np.int64), strict=True):
                    mark[i], sig[i] = m, s
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(rows.start, len(n)), pa.array(n), pa.array(mark, pa.binary()), pa.array(sig, pa.list_(pa.int64())),
            ], names=["doc_id", "n", "mark", "sig"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, some, values, first in _sets(batch.column("text")):
            if len(some):
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").slice(rows.start, rows.stop - rows.start).take(pa.array(some)),
                    pa.array(_fingerprint(values, first), pa.binary()), X.lists(values, first),
                ], names=["node", "got", "set"])


def _may_link(a: str, b: str) -> Column:
    """Sizes and shared counts allow ``4 |x and y| >= 3 |x or y|``."""
    n, m, s = (F.col(f"{a}n"), F.col(f"{b}n"), F.least(f"{a}s", f"{b}s"))
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * s >= 3 * (n + m))


def nodes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``n``, ``mark``) and the distinct sets with their signature, both written."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("mark", T.BinaryType()),
        T.StructField("sig", T.ArrayType(T.LongType())),
    ])
    signed = materialize(docs.select("doc_id", "text").mapInArrow(_signatures, schema))
    nodes = signed.where("n > 0").groupBy("mark", "n").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"))
    return signed.drop("sig"), materialize(nodes.withColumn("node", F.monotonically_increasing_id()))


def survivors_of(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that can have a partner (with values by rarity and rare shingles), and the full sets."""
    posted = nodes.select("node", "n", F.explode("sig").alias("value"))
    # counts are written before they are joined: only a plain shuffle of both sides lets Spark split a hot value
    shared = materialize(posted.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    per_node = (
        posted.join(shared, "value").groupBy("node", "n").agg(F.collect_list(F.struct("df", "value")).alias("values"))
        .where(F.size("values") >= MATCHES)
    )
    first = materialize(per_node.join(nodes.select("node", "mark", "first_id"), "node"))
    wanted = first.select("node", "mark", F.col("first_id").alias("_at"))
    texts = join_null_safe(docs.select("doc_id", "text"), wanted, {"doc_id": "_at"})
    marks = wanted.select("node", "mark")
    sets = texts.select("node", "text").mapInArrow(_shingle_sets, "node long, got binary, set array<long>")
    sets = materialize(sets.join(marks, "node").where("got = mark").select("node", "set"))
    each = sets.select("node", F.explode("set").alias("shingle"))
    common = materialize(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    counted = each.join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    n, s = F.col("n"), F.size("rare").cast("long")
    # the longest prefix any partner can ask for: a partner has three quarters of the size at least
    longest = F.greatest(F.lit(0).cast("long"), s - F.ceil(n * 0.75) + 1).cast("int")
    kept = (
        first.select("node", "n", "values").join(counted, "node").where(4 * s >= 3 * n)
        .select("node", "n", s.alias("s"), F.sort_array("values").alias("values"),
                F.transform(F.slice("rare", 1, longest), lambda x: x["shingle"]).alias("rare"))
    )
    return materialize(kept), sets


def star_pairs(nodes: DataFrame) -> DataFrame:
    """Each node with the most central node of every list it is in."""
    centre = F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    prefix = F.slice("values", 1, F.size("values") - MATCHES + 1)
    posted = nodes.select("node", "n", "s", centre.alias("c"), F.explode(F.transform(prefix, lambda x: x["value"])).alias("value"))
    pivots = posted.groupBy("value").agg(F.max(F.struct("c", "node", "n", "s")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pivots = materialize(pivots.select("value", F.col("p.node").alias("v"), F.col("p.n").alias("vn"), F.col("p.s").alias("vs")))
    met = posted.select("value", F.col("node").alias("u"), F.col("n").alias("un"), F.col("s").alias("us")).join(pivots, "value")
    return met.where("u <> v").where(_may_link("u", "v")).select("u", "v").distinct()


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(CLASS_RATIO)))).cast("int")


def cross_pairs(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components that meet in the prefix their sizes demand."""
    named = nodes.join(labels, "node", "left").select("node", "n", "s", "rare", F.coalesce("label", "node").alias("label"))
    n = F.col("n")
    own = named.withColumn("c", _class(n)).withColumn(
        "other", F.explode(F.sequence(_class(F.ceil(n * 0.75)), _class(F.floor(n / 0.75)) + 1)),
    )
    least = F.greatest(F.ceil(n * 0.75), F.floor(F.pow(F.lit(CLASS_RATIO), "other") - 1e-6))
    take = F.greatest(F.lit(0).cast("long"), F.col("s") - F.ceil((n + least) * 3 / 7 - 1e-9) + 1).cast("int")
    posted = own.select(
        "node", "n", "s", "label", "c", F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"),
        F.posexplode(F.slice("rare", 1, take)).alias("at", "shingle"),
    ).withColumn("rest", F.col("s") - F.col("at"))  # shingles from this one on, in order of rarity
    key = ["a", "b", "shingle"]
    per_label = posted.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("k"))
    open_lists = per_label.groupBy(*key).agg(F.max(F.struct("k", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_lists = materialize(open_lists)  # so that the join is a plain shuffle of both sides and a hot list can be split
    listed = materialize(posted.join(open_lists.drop("labels"), key))
    named_as = lambda df, p: df.select(*key, "top", *[F.col(c).alias(f"{p}{c}") for c in ("node", "n", "s", "label", "c", "rest")])
    left, right = named_as(listed.where("label <> top"), "u"), named_as(listed, "v").drop("top")
    met = left.join(right, key).where("ulabel <> vlabel and (a = b or uc <> vc) and (vlabel = top or unode < vnode)")
    # where two sets meet first, all they share comes from there on
    met = met.where(_may_link("u", "v")).where("7 * least(urest, vrest) >= 3 * (un + vn)")
    return met.select(F.least("unode", "vnode").alias("u"), F.greatest("unode", "vnode").alias("v")).distinct()


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that agree in ``MATCHES`` values and whose full sets have a similarity of 0.75 or more."""
    values = nodes.select("node", F.transform("values", lambda x: x["value"]).alias("values"))

    def both(df: DataFrame, of: DataFrame, column: str) -> DataFrame:
        for side in ("u", "v"):
            df = df.join(of.select(F.col("node").alias(side), F.col(column).alias(f"{side}_{column}")), side)
        return df

    matched = both(pairs, values, "values").where(F.size(F.array_intersect("u_values", "v_values")) >= MATCHES).select("u", "v")
    shared = F.size(F.array_intersect("u_set", "v_set")).cast("long")
    return (
        both(materialize(matched), sets, "set").withColumn("_shared", shared)
        .where(100 * F.col("_shared") >= 75 * (F.size("u_set") + F.size("v_set") - F.col("_shared"))).select("u", "v")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of its group), ``kept``."""
    rows, sets_of = nodes_of(docs)
    nodes, sets = survivors_of(sets_of, docs)
    links = materialize(confirmed(star_pairs(nodes), nodes, sets))
    labels = materialize(components(links))
    more = materialize(confirmed(cross_pairs(nodes, labels), nodes, sets))
    if more.limit(1).count():
        # components of components: the labels stand for what is joined already
        lift = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        up = more
        for side in ("u", "v"):
            up = up.join(lift, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_l", side)).drop("_n", "_l")
        top = components(up).select(F.col("node").alias("label"), F.col("label").alias("top"))
        all_nodes = labels.unionByName(more.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node")))
        labels = materialize(all_nodes.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    grouped = sets_of.select("node", "mark", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = materialize(grouped.groupBy("label").agg(F.min("first_id").alias("component_id")))
    of_mark = materialize(grouped.join(least, "label").select("mark", "component_id"))
    out = rows.join(of_mark, "mark", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
