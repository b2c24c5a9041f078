"""Quality by ordinal cumulative-link regression over hashed text.

Ratings are grades 0, 1, 2, ... One weight vector over hashed features gives a
score, ordered thresholds cut it: ``P(grade >= k) = logistic(score - threshold_k)``.
Expected grade and the tail probability of a chosen grade select documents.

Features: hashed words, hashed four-grams of character shapes (letters, capitals,
digits, blanks, each punctuation mark for itself), the share of words that
repeat the word before, and the presence of the ``MARKS`` words that tell the grades of the
training texts apart best: one insult weighs as much in a long text as in a short one.
All share one score, and the tail of the highest grade selects good documents that are not toxic.
A model is fitted on at most ``SAMPLE`` labelled rows,
chosen by a hash of their id; every step is a Spark job that sums the gradient
over the rows, only weights and their gradient of a fixed length meet on the driver.
Scoring reads every whole text.

Defined results: NULL and empty texts have no features and get the score 0 of
the thresholds alone. Labels that are NULL, or whose document is missing, are
left out; without any label everything is kept, with a tail probability of
one half. A separate model for toxic texts (``toxic_model_for``) flags nothing without a label that says toxic. NULL ids are scored like others. Repeated labels count as often as they are
given. An empty table gives an empty result. Extra columns are kept by
``selected`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import materialize
from tidemark.llm import text as X

#: labelled rows a model is fitted on, at most
SAMPLE = 12_000
WORD_BITS, SHAPE_BITS = 16, 13
_REPEATS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: share of repeated words above which each of the last features is set; the first one is the share itself
_SHARES = (0.02, 0.1, 0.3)
#: words that tell grades apart, at most; each has a feature of its own
MARKS = 512
_MARKED = _REPEATS + 1 + len(_SHARES)
FEATURES = _MARKED + MARKS
#: text worked on at once: bytes, and rows that are copied for it
CHUNK_BYTES, ROWS = 256 << 10, 512
#: texts, features, values
Part = tuple[np.ndarray, np.ndarray, np.ndarray]
PENALTY = 1e-4
ROUNDS = 40
#: the grade of documents that are good and not toxic, and its least probability (picked by held-out figures, see the README)
CLEAN, CLEAN_LEAST = 2, 0.7
#: of the model for toxic texts: few words decide, so they may weigh much; flagged from this probability on
TOXIC_PENALTY, TOXIC_LEAST = 1e-5, 0.2


def _shapes() -> np.ndarray:
    code = np.ones(256, np.uint32)  # lower-case letters and all bytes beyond ASCII
    code[65:91] = 2
    code[48:58] = 3
    code[32] = 4
    code[:32] = 5
    code[127] = 5
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    code[marks] = np.arange(6, 6 + len(marks))
    return code


_SHAPE = _shapes()
_NO_MARKS = np.where(_SHAPE >= 5, 32, np.arange(256)).astype(np.uint8)


def words_and_shapes(data: np.ndarray, offsets: np.ndarray) -> Iterator[Part]:
    """Hashed words, shares of words that repeat the one before, and four-grams of shapes."""
    texts = np.arange(len(offsets) - 1)
    hashes, first = X.word_hashes(data, offsets)
    words = np.diff(first)
    of = np.repeat(texts.astype(np.int32), words)
    yield of, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32), (1 / np.sqrt(np.maximum(words, 1))).astype(np.float32)[of]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    share = np.bincount(of, again, len(texts)) / np.maximum(words, 1)
    some = np.flatnonzero(share > 0)
    yield some, np.full(len(some), _REPEATS), share[some]
    for k, s in enumerate(_SHARES):
        over = np.flatnonzero(share > s)
        yield over, np.full(len(over), _REPEATS + 1 + k), np.ones(len(over))
    if len(data) < 4:
        return
    shape = _SHAPE[data]
    gram = shape[:-3] | shape[1:-2] << 6 | shape[2:-1] << 12 | shape[3:] << 18
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - SHAPE_BITS)
    size = np.diff(offsets)
    at = np.repeat(texts.astype(np.int32), size)
    inside = at[:-3] == at[3:]
    at = at[:-3][inside]
    yield at, (gram[inside] + np.uint32(1 << WORD_BITS)).astype(np.int32), (5 / np.maximum(size - 3, 1)).astype(np.float32)[at]


def presence(data: np.ndarray, offsets: np.ndarray) -> Iterator[Part]:
    """Every different word of a text, without the marks around it, however long the text is."""
    hashes, first = X.word_hashes(_NO_MARKS[data], offsets)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = np.unique(of << WORD_BITS | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    yield key >> WORD_BITS, key & ((1 << WORD_BITS) - 1), np.ones(len(key), np.float32)


def with_marks(marks: np.ndarray) -> Callable[[np.ndarray, np.ndarray], Iterator[Part]]:
    """All kinds of features; a word of ``marks`` (ascending hashes) counts once per text, however long the text is."""
    def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[Part]:
        yield from words_and_shapes(data, offsets)
        if len(marks):
            hashes, first = X.word_hashes(_NO_MARKS[data], offsets)
            at = np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)
            hit = np.flatnonzero(marks[at] == hashes)
            key = np.unique((np.searchsorted(first, hit, "right") - 1) * len(marks) + at[hit])
            yield key // len(marks), _MARKED + key % len(marks), np.ones(len(key))

    return features


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades
    make: Callable = words_and_shapes

    def scores(self, column: pa.Array) -> np.ndarray:
        """One score per text; kinds of features are added up one after the other, over little text at a time."""
        out = np.zeros(len(column))
        for lo in range(0, len(column), ROWS):
            for rows, data, offsets in X.chunks(column.slice(lo, ROWS), CHUNK_BYTES):
                n = rows.stop - rows.start
                for text, feature, value in self.make(data, offsets):
                    out[lo + rows.start: lo + rows.stop] += np.bincount(text, self.weights[feature] * value, n)
        return out


def _rows(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in X.chunks(batch.column("text"), CHUNK_BYTES):
            n = rows.stop - rows.start
            text, feature, value = (np.concatenate(a) for a in zip(*make(data, offsets), strict=True))
            key, where = np.unique(text.astype(np.int64) * FEATURES + feature, return_inverse=True)
            value = np.bincount(where, value, len(key))
            first = np.searchsorted(key // FEATURES, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("grade").slice(rows.start, n),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(key % FEATURES, pa.int32())),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.astype(np.float32))),
            ], names=["grade", "feature", "value"])


def training_texts(docs: DataFrame, labels: DataFrame, grade: Column, sample: int = SAMPLE) -> DataFrame:
    """``text`` and ``grade`` of at most ``sample`` ratings, written once.

    Of documents that share an id, the one whose text has the smallest hash counts.
    """
    rated = labels.select(F.col("doc_id").alias("_rated"), grade.cast("int").alias("grade")).where("grade is not null and _rated is not null")
    # exactly bounded, so it may be broadcast; the order is a fixed hash of the id
    chosen = materialize(rated.orderBy(F.xxhash64("_rated", F.lit(11)), "grade").limit(sample))
    ids = F.broadcast(chosen.select(F.col("_rated").alias("_id")).distinct())
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"))
    # combined on the map side, so an id that many documents share does not meet in one task
    texts = found.groupBy("_id").agg(F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text"))
    spread = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_rated")).select("_id", "text", "grade")
    return materialize(spread.repartition(spread.sparkSession.sparkContext.defaultParallelism, "_id").select("text", "grade"))


def training_rows(texts: DataFrame, make: Callable) -> DataFrame:
    """Features of training texts, written once."""
    return materialize(texts.mapInArrow(lambda batches: _rows(batches, make), "grade int, feature array<int>, value array<float>"))


def marks_of(texts: DataFrame, most: int = MARKS) -> np.ndarray:
    """Hashes of the ``most`` words whose presence tells grades apart best, by the likelihood ratio of grade and presence."""
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = batch.column("grade").to_numpy()
            for rows, data, offsets in X.chunks(batch.column("text"), CHUNK_BYTES):
                hashes, first = X.word_hashes(_NO_MARKS[data], offsets)
                each = [np.unique(hashes[lo:hi]) for lo, hi in zip(first, first[1:], strict=False)]
                of = np.repeat(grade[rows], [len(e) for e in each])
                word = np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(of, pa.int32())], names=["word", "grade"])

    sizes = {r["grade"]: r["n"] for r in texts.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.uint64)
    share = F.create_map(*[F.lit(v) for g, n in sizes.items() for v in (g, n / sum(sizes.values()))])
    counts = texts.mapInArrow(present, "word long, grade int").groupBy("word", "grade").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    ratio = F.sum(F.col("n") * F.ln(F.col("n") / F.element_at(share, F.col("grade")))) - n * F.ln(n)
    best = counts.groupBy("word").agg(F.round(ratio, 6).alias("ratio")).orderBy(F.col("ratio").desc(), "word").limit(most)
    return np.sort(np.array([r["word"] for r in best.collect()], np.int64).view(np.uint64))


def _thresholds(free: np.ndarray) -> np.ndarray:
    """First threshold and the logarithms of the gaps give ordered thresholds."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def _loss(parameters: np.ndarray, grades: int, batches: list[pa.RecordBatch]) -> np.ndarray:
    """Rows, loss and gradient of some rows as one vector."""
    w, free = parameters[:FEATURES], parameters[FEATURES:]
    cut = np.concatenate([[-np.inf], _thresholds(free), [np.inf]])
    out = np.zeros(2 + len(parameters))
    for b in batches:
        grade = b.column("grade").to_numpy().astype(int)
        lists = b.column("feature")
        count = np.diff(lists.offsets.to_numpy())
        feature, value = lists.flatten().to_numpy(), b.column("value").flatten().to_numpy().astype(float)
        row = np.repeat(np.arange(len(grade)), count)
        score = np.bincount(row, w[feature] * value, len(grade))
        logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        upper, lower = logistic(score - cut[grade]), logistic(score - cut[grade + 1])
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = dl - du
        out[0] += len(grade)
        out[1] -= np.log(p).sum()
        out[2: 2 + FEATURES] += np.bincount(feature, slope[row] * value, FEATURES)
        by_cut = np.bincount(grade, du, grades + 1) - np.bincount(grade + 1, dl, grades + 1)
        inner = by_cut[1:grades]
        out[2 + FEATURES] += inner.sum()
        for k in range(1, grades - 1):
            out[2 + FEATURES + k] += inner[k:].sum() * np.exp(free[k])
    return out


def fit(rows: DataFrame, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Limited-memory quasi-Newton steps; each loss and gradient is a job over ``rows``."""
    top = rows.agg(F.max("grade")).first()[0]
    if not top:
        return Model(np.zeros(FEATURES), np.zeros(1))
    grades = top + 1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([_loss(x, grades, list(batches)).tobytes()], pa.binary())], names=["part"])

        total = sum(np.frombuffer(r["part"]) for r in rows.mapInArrow(run, "part binary").collect())
        g = total[2:] / total[0] + penalty * x
        return total[1] / total[0] + 0.5 * penalty * x @ x, g

    x = np.zeros(FEATURES + grades - 1)
    x[FEATURES] = -1.0
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step = g.copy()
        kept = []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            kept.append(a)
            step -= a * y
        if past:
            s, y = past[-1]
            step *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            step += s * (a - y @ step / (s @ y))
        rate = 1.0 if past else 1.0 / max(1e-12, np.abs(step).max())
        for _ in range(12):
            new = x - rate * step
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * rate * (g @ step):
                break
            rate /= 2
        else:
            break
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y)]
        done = value - new_value < 1e-4 * value
        x, value, g = new, new_value, new_g
        if done:
            break
    return Model(x[:FEATURES], _thresholds(x[FEATURES:]))


def score_column(model: Model, text: str = "text") -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(column))

    return score(F.col(text))


def tail(model: Model, score: Column, grade: int) -> Column:
    """Probability of ``grade`` or more."""
    return 1 / (1 + F.exp(F.lit(float(model.thresholds[grade - 1])) - score))


def expected(model: Model, score: Column) -> Column:
    """The expected grade is the sum of the tail probabilities."""
    return sum((tail(model, score, k + 1) for k in range(1, len(model.thresholds))), tail(model, score, 1))


def _harm(toxic: Model | None) -> Column:
    """Probability that a text is toxic."""
    return F.lit(0.0) if toxic is None else tail(toxic, score_column(toxic), 1)


def _cut(model: Model, grade: int, least: float) -> tuple[int, float]:
    """A grade that the model knows, and one half as the least probability while it knows nothing."""
    return min(grade, len(model.thresholds)), least if model.weights.any() else min(least, 0.5)


def judge(docs: DataFrame, model: Model, grade: int = 1, least: float = 0.5, toxic: Model | None = None) -> DataFrame:
    """Every document with ``expected_grade``, ``tail_probability`` of ``grade`` and ``kept``.

    With a model for ``toxic`` texts also ``toxic_probability`` and ``toxic``; what is flagged is not kept.
    """
    grade, least = _cut(model, grade, least)
    scored = docs.select("doc_id", score_column(model).alias("score"), _harm(toxic).alias("toxic_probability"))
    p = tail(model, F.col("score"), grade)
    flagged = F.col("toxic_probability") >= TOXIC_LEAST
    out = [expected(model, F.col("score")).alias("expected_grade"), p.alias("tail_probability"), ((p >= least) & ~flagged).alias("kept")]
    return scored.select("doc_id", *out, *([] if toxic is None else ["toxic_probability", flagged.alias("toxic")]))


def selected(docs: DataFrame, model: Model, grade: int = 1, least: float = 0.5, toxic: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose tail probability is high enough and that are not flagged, all columns as they are."""
    grade, least = _cut(model, grade, least)
    good = tail(model, score_column(model), grade) >= least
    return docs.where(good if toxic is None else good & (_harm(toxic) < TOXIC_LEAST))


def model_for(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Grades from the two labels: 0 low quality, 1 good but toxic, ``CLEAN`` good."""
    good = F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(CLEAN))
    texts = training_texts(docs, labels, good, sample)
    make = with_marks(marks_of(texts))
    return replace(fit(training_rows(texts, make)), make=make)


def toxic_model_for(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Grade 1 is toxic, whatever the quality."""
    texts = training_texts(docs, labels, (F.col("toxic") > 0).cast("int"), sample)
    model = replace(fit(training_rows(texts, presence), penalty=TOXIC_PENALTY), make=presence)
    # without a toxic label there is nothing to tell apart
    return model if model.weights.any() else replace(model, thresholds=np.array([np.inf]))
