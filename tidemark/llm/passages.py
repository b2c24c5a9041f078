"""Removal of repeated passages by global digests of lines and sentences.

Units are lines and the sentences within them (cut at ``.``, ``!``, ``?`` and line feeds), lower-cased
(A-Z) with white space collapsed. Their digests are grouped over the whole table; the occurrence ranked
first (smallest document id, then place) stays. Any other occurrence is a repeat, and repeats
are removed where neighbouring ones add up to a passage: a stretch of ``STRETCH`` words or more, with at most
``GAP`` differing units between two repeats. So a passage is found wherever it begins and ends within
a line, a long line or a paragraph of short lines as well, while a sentence that two texts share by chance stays.

Units of less than ``LEAST`` words, of which any text has some, neither count nor interrupt. A
repeated line counts with all its words, also those of its short sentences. Places are code points of the original text.

Work is done on bytes of some hundred KB with NumPy; digests are 128 bits made of 64-bit word hashes.

Defined results: NULL and empty texts have no units. A NULL id ranks last; rows that share an id rank by
place. Rows equal in id and text are cleaned alike, so that what only they repeat stays. An empty table
gives an empty result. Extra columns are kept by ``cleaned`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.session import materialize
from tidemark.llm import text as X

#: words of a unit that counts, words of a passage, differing units within a passage
LEAST, STRETCH, GAP = 3, 25, 1
CHUNK_BYTES = 512 << 10
LINE, SENTENCE = 0, 1
_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_CUT = _BREAK.copy()
_CUT[[ord(c) for c in ".!?"]] = True
_WITHOUT_MARKS = np.where(_CUT & ~_BREAK, 32, np.arange(256)).astype(np.uint8)
_POWERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Units:
    """Units with words, in order: text, first and last byte, words, two halves of the digest."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    a: np.ndarray
    b: np.ndarray


def _units(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> Units:
    """Units between ``cuts`` (places of separators, which must be white space in ``data``)."""
    texts = np.arange(len(offsets) - 1)
    of_cut = np.searchsorted(offsets, cuts, "right") - 1
    text = np.concatenate([texts, of_cut])
    start, end = np.concatenate([offsets[:-1], cuts + 1]), np.concatenate([cuts, offsets[1:]])
    start = start[np.lexsort((start, text))]
    by_end = np.lexsort((end, np.concatenate([of_cut, texts])))
    end, text = end[by_end], np.concatenate([of_cut, texts])[by_end]
    hashes, _ = X.word_hashes(data, offsets)
    word = ~X.IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = word[at]
    before = np.append(0, np.cumsum(begins))
    words = before[end] - before[start]
    some = words > 0
    text, start, end, words = text[some], start[some], end[some], words[some]
    lanes = []
    first = np.cumsum(words) - words
    place = np.arange(len(hashes)) - np.repeat(first, words)
    for k, step in enumerate(_POWERS):
        power = np.full(int(words.max(initial=1)), step)
        power[0] = 1
        power = np.multiply.accumulate(power)
        terms = (X.mix(hashes) if k else hashes) * power[place]
        lanes.append(X.mix(np.add.reduceat(terms, first) + words.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64))
    return Units(text, start, end, words, *lanes)


def _found(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Lines and sentences that count, with the slots they take in the order of their text."""
    marks = np.flatnonzero(_CUT[data])
    sentences = _units(_WITHOUT_MARKS[data], offsets, marks)
    lines = _units(data, offsets, marks[data[marks] == 10])
    long = sentences.words >= LEAST
    line_of = np.searchsorted(lines.start, sentences.start, "right") - 1
    inside = np.bincount(line_of[long], minlength=len(lines.text))
    covered = np.bincount(line_of[long], sentences.words[long], len(lines.text))
    lone = (lines.words >= LEAST) & (inside == 0)
    # slots: sentences that count, and lines that count without one, by their place in the text
    starts = np.concatenate([sentences.start[long], lines.start[lone]])
    texts = np.concatenate([sentences.text[long], lines.text[lone]])
    rank = np.empty(len(starts), np.int64)
    rank[np.argsort(starts, kind="stable")] = np.arange(len(starts))
    slot = rank - np.searchsorted(np.sort(texts), texts)
    of_sentence, of_lone = slot[: long.sum()], slot[long.sum():]
    first = np.zeros(len(lines.text), np.int64)
    first[lone] = of_lone
    last = first.copy()
    first[line_of[long][::-1]] = of_sentence[::-1]
    last[line_of[long]] = of_sentence
    # lines whose sentences say all about them are left out
    use = (lines.words >= LEAST) & (covered < lines.words)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    pair = lambda line, sentence: np.concatenate([line[use], sentence[long]])
    text = pair(lines.text, sentences.text)
    base = points[offsets[text]]
    return {
        "text": text, "kind": np.repeat([LINE, SENTENCE], [use.sum(), long.sum()]), "start": points[pair(lines.start, sentences.start)] - base,
        "end": points[pair(lines.end, sentences.end)] - base, "slot": np.concatenate([first[use], of_sentence]), "slot_to": np.concatenate([last[use], of_sentence]),
        "words": pair(lines.words, sentences.words), "a": pair(lines.a, sentences.a).view(np.int64), "b": pair(lines.b, sentences.b).view(np.int64),
    }


_LONGS = ("kind", "start", "end", "slot", "slot_to", "words", "a", "b")


def units_of(docs: DataFrame) -> DataFrame:
    """One narrow row per unit that counts; texts travel no further."""
    names = ["doc_id", "text_key", "row_no", *_LONGS]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.chunks(batch.column("text"), CHUNK_BYTES):
                found = _found(data, offsets)
                at = pa.array(found["text"] + rows.start)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in names[:3]], *[pa.array(found[n].astype(np.int64)) for n in _LONGS]], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row_no"), "text")
    return rows.mapInArrow(run, schema)


def repeated(docs: DataFrame, stretch: int = STRETCH, gap: int = GAP) -> DataFrame:
    """Units of passages to be removed, with the occurrence that stays (``keep_doc_id``, ``keep_start``).

    ``passage_words`` is the size of the passage a unit belongs to; ``text_key`` and ``keep_text_key`` tell rows that share an id apart.
    """
    found = materialize(units_of(docs))
    digest = ["kind", "a", "b"]
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start", "row_no", "text_key")
    # combined on the map side: a frequent unit travels as one row per task
    groups = found.groupBy(*digest).agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    groups = materialize(groups)  # so that the join is a plain shuffle of both sides and a hot unit can be split
    repeats = found.join(groups, digest).where((F.col("row_no") != F.col("keep.row_no")) | (F.col("start") != F.col("keep.start")))
    # what follows is within a document
    order = Window.partitionBy("row_no").orderBy("slot", F.col("slot_to").desc(), "kind")
    past = F.max("slot_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = repeats.withColumn("_past", past).withColumn("_new", (F.col("_past").isNull() | (F.col("slot") > F.col("_past") + 1 + gap)).cast("int"))
    # sentences of a line that is a repeat itself
    own = seen.withColumn("_part", F.sum("_new").over(order)).where(F.col("_past").isNull() | (F.col("slot_to") > F.col("_past")))
    whole = own.withColumn("passage_words", F.sum("words").over(Window.partitionBy("row_no", "_part"))).where(F.col("passage_words") >= stretch)
    return whole.select(
        "doc_id", F.when(F.col("kind") == LINE, "line").otherwise("sentence").alias("unit"), "start", "end", F.col("keep.doc_id").alias("keep_doc_id"),
        F.col("keep.start").alias("keep_start"), "occurrences", "passage_words", "text_key", F.col("keep.text_key").alias("keep_text_key"),
    )
