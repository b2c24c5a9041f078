"""Best-fit packing of documents into sequences by large-item matching.

Texts are tokenised in tasks and cut into pieces no longer than a sequence.
A piece is known by its length alone, and a histogram of lengths has at most
``capacity`` rows whatever the corpus. The plan is made on it: pieces above a
third of the capacity are matched greedily, at most two to a sequence, largest
first with the largest partner that fits; smaller ones then go, largest first,
where they leave the least room. Equal sequences are handled as one entry with
a count, so the plan holds rules like "the 5th to 900th piece of length 700
go to sequences 40 to 935 at offset 1200". The pieces are numbered within their
length by a distributed scan and find their rule by a join.

Defined results: NULL text counts as empty, a document of the end token alone.
NULL and repeated ids are documents of their own. An empty table gives an empty
result. Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordered import positions
from tidemark.functions.session import materialize
from tidemark.llm.tokens import Tokens

CAPACITY = 2048
END = 0


@lru_cache(maxsize=4)
def _tokens(path: str) -> Tokens:
    return Tokens(path, literal=False)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; of a longer document only the first is shorter than a sequence."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, length, capacity)]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, ends in _tokens(path).encode(batch.column("text")):
                row, piece, start, length, crc, parts = [], [], [], [], [], []
                begin = 0
                for i, end in enumerate(ends.tolist()):
                    whole = np.append(ids[begin:end], np.uint32(END))
                    begin = end
                    for k, (s, n) in enumerate(cut(len(whole), capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(whole[s: s + n]))
                        if with_ids:
                            parts.append(whole[s: s + n].astype(np.int32))
                cols = [
                    batch.column("doc_id").slice(rows.start, rows.stop - rows.start).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(parts, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, on request the ``ids``."""
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, with_ids), T.StructType(fields))


@dataclass
class Run:
    """``count`` sequences in a row, from number ``first``, all filled up to ``used``."""

    first: int
    count: int
    used: int


@dataclass(frozen=True)
class Rule:
    """Pieces ``lo`` to ``hi`` (exclusive, 0-based) of a length, ``each`` of them to a sequence from ``first`` on."""

    length: int
    lo: int
    hi: int
    first: int
    offset: int
    each: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Rule]:
    """Rules for every piece. Work and size depend on the number of different lengths only."""
    left = {n: c for n, c in histogram.items() if c}
    given = dict.fromkeys(left, 0)
    rules: list[Rule] = []
    rooms: dict[int, list[Run]] = {}
    order: list[int] = []  # rooms that exist, ascending
    made = 0

    def put(n: int, run: Run, each: int, count: int) -> None:
        rules.append(Rule(n, given[n], given[n] + count, run.first, run.used, each))
        given[n] += count
        left[n] -= count
        run.used += n * each

    def keep(run: Run) -> None:
        room = capacity - run.used
        if room and run.count:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append(run)

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fit = bisect_left(large, capacity - n + 1) - 1
        partner = large[fit] if fit >= 0 else None
        if partner == n:
            pairs = left[n] // 2
            if not pairs:
                partner = large[fit - 1] if fit > 0 else None
        if partner is None:
            run = Run(made, left[n], 0)
            put(n, run, 1, left[n])
        elif partner == n:
            run = Run(made, pairs, 0)
            put(n, run, 2, 2 * pairs)
        else:
            run = Run(made, min(left[n], left[partner]), 0)
            put(n, run, 1, run.count)
            put(partner, run, 1, run.count)
        made += run.count
        keep(run)
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                full, over = divmod(left[n], each)
                if full:
                    run = Run(made, full, 0)
                    put(n, run, each, full * each)
                    made += full
                    keep(run)
                if over:
                    run = Run(made, 1, 0)
                    put(n, run, over, over)
                    made += 1
                    keep(run)
                continue
            room = order[at]
            run = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            # one piece to each sequence first gives as many as possible; more go in together where all get them
            each = min(room // n, max(1, left[n] // run.count))
            count = min(run.count, left[n] // each)
            if count < run.count:
                keep(Run(run.first + count, run.count - count, run.used))
                run = Run(run.first, count, run.used)
            put(n, run, each, count * each)
            keep(run)
    return rules


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece; ``cut_pieces`` should be a written table."""
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules = spark.createDataFrame(
        [(r.length, r.lo, r.hi, r.first, r.offset, r.each) for r in plan(histogram, capacity)],
        "_length long, _lo long, _hi long, _first long, _offset long, _each long",
    )
    numbered = positions(cut_pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "_turn")
    turn = F.col("_turn") - 1
    # the rules are bounded by the number of lengths, whatever the corpus
    placed = numbered.join(F.broadcast(rules), (F.col("length") == F.col("_length")) & (turn >= F.col("_lo")) & (turn < F.col("_hi")))
    within = turn - F.col("_lo")
    return placed.select(
        *cut_pieces.columns, (F.col("_first") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(within, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once so that no text is tokenised twice."""
    return pack(materialize(pieces(docs, tokenizer, capacity, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ``ids``: at most ``capacity`` tokens a row."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
