"""The trie of conversation prefixes, with a count-min screen before anything is grouped.

A turn is known by a digest of its role and text, a prefix by a digest of its turns and their
places: a sum per lane, so that running sums give all prefixes of a conversation, however long
it is, without one task holding it. A count-min sketch counts the prefix digests. It never counts
too few: a prefix of estimate one has one conversation, proven, and its node is emitted where
it is, by its own columns alone. Only prefixes that may be shared are shuffled and grouped exactly,
so an estimate that is too high costs a row and changes nothing.

What a subtree adds up to comes from its conversations: every node is booked on its smallest member,
whose path runs through all nodes above it. Sums from the end of each path, added over
the members of a node, count every node of its subtree once; no tree is walked.

The sketch keeps "once" and "more than once" as one bit each per cell. It is built per partition,
merged slice by slice in steps, and has at most ``2 ** MOST_BITS`` cells in each of its ``DEPTH``
rows; with far more prefixes than that it lets more of them through, results stay the same.

Defined results: rows without ``conv_id`` take no part. Equal turn numbers of a conversation, and NULL ones,
which come first, are ordered by the digest of role and text; equal rows are turns of their own. A very
long conversation, or one turn that starts very many, is spread over tasks. Only the concatenated
ids of a node's members run through one task, in pieces, as their hash demands. An empty table
gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordered import running
from tidemark.functions.session import materialize
from tidemark.llm.columns import WORD, whole_text

#: rows of the sketch, and the most cells in each as a power of two (a bit each, twice)
DEPTH, MOST_BITS = 4, 26
SLICE_BYTES = 1 << 16
#: sketches that are merged at once
FAN = 32
#: bytes of joined ids that travel as one row
PIECE_BYTES = 1 << 20
_CELL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- sequences -------------------------------------------------------------------------------------------------------

def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), ``item`` (digest of role and text), ``words``, ``n_turns``; texts travel no further."""
    role, text = whole_text("role"), whole_text("text")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("item"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = running(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("item")], {"place": ("sum", F.lit(1).cast("long"))}, totals=True)
    return materialize(placed.select("conv_id", "place", "item", "words", F.col("n_rows").alias("n_turns")))


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block: 0 to 3."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, block: int = 20, most: int = 3, take: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first one of their block of ids.

    ``take`` says how many (up to ``most``) of the first turns come from conversation ``c - c % block``; the conversation's own
    turns follow without as many of their first. Gives the turns (``conv_id``, ``depth``, ``item``, ``words``), and one row per conversation with its ``length``.
    """
    h = head_turns(F.col("conv_id")) if take is None else take
    base = F.col("conv_id") - F.col("conv_id") % block
    firsts = turns.where((F.col("place") <= most) & (F.col("conv_id") % block == 0))
    heads = materialize(firsts.groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("place", "item", "words"))).alias("head")))
    convs = turns.where("place = 1").select("conv_id", "n_turns", h.alias("h"), base.alias("base"))
    convs = convs.join(heads, F.col("base") == F.col("_base"), "left").drop("_base")
    borrowed = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0))).cast("long")
    convs = materialize(convs.select("conv_id", F.slice("head", 1, F.col("h").cast("int")).alias("head"),
                                     (borrowed + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("length")))
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.item", "t.words")
    own = turns.select("conv_id", "place", "item", "words", h.alias("h"), base.alias("base")).where(F.col("place") > F.col("h"))
    # both sides are written tables, so that a conversation with very many turns can be split
    known = heads.select("_base", F.size("head").cast("long").alias("_held"))
    own = own.join(known, F.col("base") == F.col("_base"), "left")
    depth = F.col("place") - F.col("h") + F.least(F.col("h"), F.coalesce("_held", F.lit(0)))
    return first.unionByName(own.select("conv_id", depth.alias("depth"), "item", "words")), convs.select("conv_id", "length")


def prefixes(sequences: DataFrame) -> DataFrame:
    """Every prefix: ``conv_id``, ``depth``, its digest (``a``, ``b``), that of its parent, ``words`` of its last turn, whether it is the ``last``."""
    lanes = {f"_{k}": F.shiftrightunsigned(F.xxhash64(F.lit(k), "depth", "item"), 32) for k in range(4)}
    summed = running(sequences, ["conv_id"], [F.col("depth")], {k: ("sum", e) for k, e in lanes.items()}, totals=True)
    low = F.lit((1 << 32) - 1)
    packed = lambda x, y: F.shiftleft(x.bitwiseAND(low), 32).bitwiseOR(y.bitwiseAND(low))
    before = {k: F.col(k) - e for k, e in lanes.items()}
    return materialize(summed.select(
        "conv_id", "depth", packed(F.col("_0"), F.col("_1")).alias("a"), packed(F.col("_2"), F.col("_3")).alias("b"),
        packed(before["_0"], before["_1"]).alias("pa"), packed(before["_2"], before["_3"]).alias("pb"),
        "words", (F.col("depth") == F.col("n_rows")).alias("last"),
    ))


# --- the screen ------------------------------------------------------------------------------------------------------

def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """One cell per row of the sketch for every digest."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    mixed = (a[None] ^ (b[None] * _CELL[:, None])) * _CELL[::-1, None]
    return (mixed ^ (mixed >> np.uint64(29))) * _CELL[:, None] >> np.uint64(64 - bits)


class Sketch:
    """Cells with one bit for "met" and one for "met again"."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
        self.again = np.zeros_like(self.once)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for r, cells in enumerate(_cells(a, b, self.bits)):
            cell, count = np.unique(cells, return_counts=True)
            byte, bit = (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8)
            repeat = (count > 1) | ((self.once[r, byte] & bit) > 0)
            np.bitwise_or.at(self.again[r], byte[repeat], bit[repeat])
            np.bitwise_or.at(self.once[r], byte, bit)


def met_again(again: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether a digest's estimate, the least of its cells, is above one."""
    out = np.ones(len(a), bool)
    for r, cells in enumerate(_cells(a, b, bits)):
        out &= (again[r, (cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def sketch(digests: DataFrame, bits: int) -> np.ndarray:
    """The "met again" bits of all digests (``a``, ``b``); of a fixed size, so they may reach the driver."""
    row_bytes = (1 << bits) // 8
    slice_bytes = min(SLICE_BYTES, row_bytes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(bits)
        for batch in batches:
            own.add(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        part = TaskContext.get().partitionId()
        once, again = own.once.reshape(-1, slice_bytes), own.again.reshape(-1, slice_bytes)
        for s in np.flatnonzero(once.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pylist([{"part": part, "slice": s, "once": zlib.compress(once[s], 1), "again": zlib.compress(again[s], 1)}], made)

    def merge(t: pa.Table) -> pa.Table:
        once, again = np.zeros(slice_bytes, np.uint8), np.zeros(slice_bytes, np.uint8)
        for o, m in zip(t["once"].to_pylist(), t["again"].to_pylist(), strict=True):
            o, m = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(m), np.uint8)
            again |= m | (once & o)
            once |= o
        return pa.Table.from_pylist([{"part": t["part"][0].as_py() // FAN, "slice": t["slice"][0].as_py(), "once": zlib.compress(once, 1), "again": zlib.compress(again, 1)}], made)

    made = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])
    schema = "part int, slice int, once binary, again binary"
    parts = materialize(digests.select("a", "b").mapInArrow(build, schema))
    highest = parts.agg(F.max("part")).first()[0] or 0
    while highest:
        parts, highest = parts.groupBy("slice", F.floor(F.col("part") / FAN)).applyInArrow(merge, schema), highest // FAN
    out = np.zeros((DEPTH * row_bytes // slice_bytes, slice_bytes), np.uint8)
    for r in parts.select("slice", "again").toLocalIterator():
        out[r["slice"]] = np.frombuffer(zlib.decompress(bytes(r["again"])), np.uint8)
    return out.reshape(DEPTH, row_bytes)


def screened(every: DataFrame, most_bits: int | None = None) -> DataFrame:
    """``every`` prefix with ``shared`` and ``parent_shared``: whether more than one conversation may have it, or its parent (the root apart)."""
    n = every.count()
    bits = min(MOST_BITS if most_bits is None else most_bits, max(4, (2 * n).bit_length()))
    again = sketch(every, bits)

    @F.arrow_udf(T.BooleanType())
    def may_be_shared(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(met_again(again, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), bits))

    shared = may_be_shared("a", "b").alias("shared")
    return materialize(every.select("*", shared, may_be_shared("pa", "pb").alias("_p")).withColumn("parent_shared", (F.col("depth") > 1) & F.col("_p")).drop("_p"))


# --- nodes -----------------------------------------------------------------------------------------------------------

def ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ``conv_id`` of each (``a``, ``b``).

    Ordered tasks join neighbours to pieces; then the pieces of a node, and nothing else, pass through one hash.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        made = []
        for batch in batches:
            for a, b, c in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "conv_id")), strict=True):
                if ids and ((a, b) != key or size >= PIECE_BYTES):
                    made.append((*key, first, ",".join(ids)))
                    ids = []
                if not ids:
                    key, first, size = (a, b), c, 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if made:
                yield _batch(made, "a", "b", "first", "piece")
                made = []
        if ids:
            yield _batch([(*key, first, ",".join(ids))], "a", "b", "first", "piece")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for a, b, piece in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "piece")), strict=True):
                if (a, b) == key:
                    state.update(b",")
                else:
                    if state:
                        made.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(piece.encode())
            if made:
                yield _batch(made, "ea", "eb", "hash")
        if state:
            yield _batch([(*key, state.hexdigest())], "ea", "eb", "hash")

    def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string() if n in ("piece", "hash") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=list(names))

    order = ["a", "b", "conv_id"]
    joined = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "a long, b long, first long, piece string")
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "ea long, eb long, hash string")


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie, from screened prefixes and one row per conversation with its ``length``."""
    least, n_convs = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not n_convs:
        return rows.select(*[F.lit(None).cast("string" if n == "ends_sha256" else "long").alias(n) for n in NODE]).limit(0)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    at_root = F.col("depth") == 1
    # proven singletons: everything about them stands in their own row
    single = rows.where(~F.col("shared"))
    known = [
        F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    ]
    parent = F.when(at_root, F.lit(least)).otherwise(F.col("conv_id")).alias("parent_conv_id")
    alone = single.where(~F.col("parent_shared")).select("conv_id", "depth", parent, *known)

    # possibly shared ones: grouped exactly, combined on the map side
    shared = rows.where("shared")
    groups = materialize(shared.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    ))
    of = groups.select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("conv_id").alias("above"))
    to_parent = (F.col("pa") == F.col("ga")) & (F.col("pb") == F.col("gb"))
    tails = single.where("parent_shared").join(of, to_parent).select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *known)
    below = groups.where(~at_root).select("pa", "pb").unionByName(single.where("parent_shared").select("pa", "pb"))
    kids = below.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("_kids"))
    held = groups.join(kids, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left").drop("ka", "kb")
    held = materialize(held.withColumn("n_children", F.coalesce("_kids", F.lit(0)).cast("long")).drop("_kids"))

    # each node is booked on its smallest member; sums from the end of every path
    info = held.select(F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("conv_id").alias("least"), F.col("n_convs").alias("n"), F.col("n_children").alias("k"))
    seen = shared.select("conv_id", "depth", "a", "b", "words", "last").join(info, (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")))
    booked = F.col("least") == F.col("conv_id")
    path = seen.select(
        "conv_id", "depth", "a", "b", F.when(booked & F.col("last") & (F.col("k") == 0), 1).otherwise(0).cast("long").alias("_leaf"),
        F.when(booked, (F.col("n") - 1) * F.col("words")).otherwise(0).cast("long").alias("_saved"),
    )
    tips = single.where("last").select("conv_id", "depth", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"),
                                       F.lit(1).cast("long").alias("_leaf"), F.lit(0).cast("long").alias("_saved"))
    summed = running(path.unionByName(tips), ["conv_id"], [F.col("depth").desc()], {"leaves": ("sum", F.col("_leaf")), "saved": ("sum", F.col("_saved"))})
    sums = summed.where("a is not null").groupBy(F.col("a").alias("sa"), F.col("b").alias("sb")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    full = held.join(sums, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))).drop("sa", "sb")
    above = F.when(at_root, F.lit(least)).otherwise(F.coalesce("above", F.col("conv_id")))
    full = materialize(full.join(of, to_parent, "left").select("a", "b", "conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"))

    top = full.where(at_root).agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    first_tails = single.where(at_root).count()
    children, leaves = top[0] + first_tails, (top[1] or 0) + first_tails
    no_node = F.lit(0).cast("long")
    root = (least, 0, None, n_convs, children, leaves or 1, top[2] or 0)
    root_row = rows.sparkSession.range(1).select(no_node.alias("a"), no_node.alias("b"), *[F.lit(v).cast("long").alias(n) for n, v in zip(NODE[:-1], root, strict=True)])
    turnless = convs.where("length = 0").select(no_node.alias("a"), no_node.alias("b"), "conv_id")
    hashes = ends(shared.where("last").select("a", "b", "conv_id").unionByName(turnless))
    grouped = full.unionByName(root_row).join(hashes, (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left")
    return alone.unionByName(tails).unionByName(grouped.select(*NODE[:-1], F.coalesce("hash", nothing).alias("ends_sha256")))


def trie(conversations: DataFrame, most_bits: int | None = None) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    sequences, convs = rebuilt(numbered(conversations))
    return nodes(screened(prefixes(sequences), most_bits), convs)
