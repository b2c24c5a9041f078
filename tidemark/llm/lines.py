"""Removal of repeated lines or paragraphs by global digests of normalised units.

A unit is a line, a paragraph (lines up to a blank one), or a run: two or more
consecutive lines of less than ``MIN_WORDS`` words each, so that a passage broken
into short lines is one unit. Normalised, it is
lower-cased (A-Z) with runs of ASCII white space as one blank and none at its
ends. Units of ``min_words`` words or more are grouped by digest over the whole
table; the occurrence ranked first (smallest document id, then position) stays,
all others are removed. Their places are code points of the original text.

Defined results: NULL and empty texts have no units. A NULL id ranks last; rows
that repeat an id rank by position alone, equal ranks by nothing that shows. An
empty table gives an empty result. Extra columns are kept by ``cleaned`` and not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import materialize
from tidemark.llm.columns import join_null_safe

#: shorter units are ordinary repetition
MIN_WORDS = 20
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_LINE = re.compile(r"^[^\n]*", re.MULTILINE)
_LOWER = {c: c + 32 for c in range(65, 91)}
_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\x09-\x0D]*\n")}


def _runs(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of runs of short lines; blank and long lines end a run."""
    start, end, count, words = 0, 0, 0, []
    for m in _LINE.finditer(text):
        own = [w for w in _SPACES.split(m[0].translate(_LOWER)) if w]
        if 0 < len(own) < MIN_WORDS:
            start, end, count = start if count else m.start(), m.end(), count + 1
            words += own
            continue
        if count > 1:
            yield start, end, words
        count, words = 0, []
    if count > 1:
        yield start, end, words


def units(text: str, unit: str = "line", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, start, end, digest) of the units that are long enough."""
    if unit == "run":
        for number, (start, end, words) in enumerate(_runs(text)):
            if len(words) >= min_words:
                yield number, start, end, blake2b(" ".join(words).encode(), digest_size=16).digest()
        return
    start = number = 0
    while start <= len(text):
        cut = _BREAK[unit].search(text, start)
        end = cut.start() if cut else len(text)
        words = [w for w in _SPACES.split(text[start:end].translate(_LOWER)) if w] if end - start >= 2 * min_words - 1 else []
        if words and len(words) >= min_words:
            yield number, start, end, blake2b(" ".join(words).encode(), digest_size=16).digest()
        if not cut:
            return
        start, number = cut.end(), number + 1


def units_of(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One narrow row per unit: ``doc_id``, ``text_key`` (hash of the text), ``unit``, ``start``, ``end``, ``digest``."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("unit", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("digest", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *u) for i, t in enumerate(batch.column("text")) if t.is_valid for u in units(t.as_py(), unit, min_words)]
            row, number, start, end, digest = zip(*found, strict=True) if found else ((),) * 5
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(number, pa.int64()), pa.array(start, pa.int64()),
                pa.array(end, pa.int64()), pa.array(digest, pa.binary()),
            ], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def repeated(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit to be removed, with the occurrence that stays (``keep_doc_id``, ``keep_start``)."""
    found = materialize(units_of(docs, unit, min_words).withColumn("row_no", F.monotonically_increasing_id()))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "unit", "row_no", "start", "text_key")
    # combined on the map side: a frequent line travels as one row per task
    groups = found.groupBy("digest").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    groups = materialize(groups)  # so that the join is a plain shuffle of both sides and a hot line can be split
    return (
        found.join(groups, "digest").where(F.col("row_no") != F.col("keep.row_no"))
        .select("doc_id", "unit", "start", "end", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "occurrences",
                "text_key", F.col("keep.text_key").alias("keep_text_key"))
    )


def cleaned(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the removed units, and in ``kept_spans`` the original places of what is left.

    The break after a removed unit goes with it. Spans belong to rows of their id and text: rows that share an id, and those
    without one, keep apart. Rows equal in both are cleaned alike; what stays in one of them stays in all.
    """
    own_first = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("text_key") == F.col("keep_text_key")) & (F.col("start") == F.col("keep_start"))
    # one row per document and span, however many copies a row has; a document's spans are bounded by its text
    spans = removed.where(~own_first).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_line_cuts"))
    spans = materialize(spans.select(F.col("doc_id").alias("_line_of"), F.col("text_key").alias("_line_key"), "_line_cuts"))
    docs = docs.withColumn("_line_own", F.xxhash64("text"))
    size = F.length("text")
    joined = join_null_safe(docs, spans, {"doc_id": "_line_of", "_line_own": "_line_key"}, "left").withColumn("_line_cuts", F.coalesce("_line_cuts", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    ends = F.transform("_line_cuts", lambda c: F.least(c["end"] + 1, size.cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), ends)
    stops = F.concat(F.transform("_line_cuts", lambda c: c["start"]), F.array(size.cast("long")))
    kept = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda s: s["end"] > s["start"])
    text = F.when(F.size("_line_cuts") == 0, F.col("text")).otherwise(
        F.array_join(F.transform("kept_spans", lambda s: F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")
    )
    return joined.withColumn("kept_spans", kept).withColumn("text", text).drop("_line_cuts", "_line_own")
