"""Hard negatives by the threshold algorithm of Fagin, Lotem and Naor on integer vectors.

Components become integers, ``floor(256 x)``; a row's score is its inner product with the
anchor. The rows are dealt to chunks, the anchors to blocks, and every block meets every
chunk once. In a chunk each dimension has a sorted list. An anchor walks the lists
whose component it uses, from the top where its own is positive and from the bottom where it
is negative; rows met for the first time are scored on all their components, exactly. No
row not met yet can score more than the anchor against the last values of the lists, the
threshold. An anchor is done with a chunk when the threshold is strictly below the k-th score
of each of its windows (rows of equal score might still come, and ties go to the smaller
id), or below the window itself.

First the best rows of the anchor's own label are found, its positives. Each opens a window of
scores relative to its own, and the best rows of other labels within it are the hard negatives.
Partial lists of the chunks are merged by rank.

Defined results: rows without id or label, and vectors that are NULL or hold NULL or non-finite
components, take no part. Shorter vectors count as filled up with zeros. Rows equal in id, label
and vector count once; other rows that share an id are rows of their own, but no row is its own
id's positive or negative. Scores beyond 64 bits are clamped to them. An anchor without
positives, and a positive without negatives in its window, give no rows. An empty table gives
an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.session import materialize

SCALE = 256
#: components of data rows, and of anchors, that a task holds at once
CHUNK_CELLS, BLOCK_CELLS = 1 << 21, 1 << 19
#: rows of a chunk that is not worth cutting further
SMALL_CHUNK = 1024
#: entries of each list that the first round reads; every round doubles the depth
FIRST_DEPTH = 16
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and integer components (as doubles) of the rows that take part, once each."""
    real = F.transform("embedding", lambda x: x.cast("double") * scale)
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # numbers beyond 2^52 are integers already, and floor() would give them as 64 bits
    whole = F.transform(real, lambda x: F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select("vec_id", "label", whole.alias("v")).distinct()


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    count = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Lists:
    """Rows with a sorted list per dimension. Rows should be given in the order of their ids."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.order, 0)
        self.largest = np.abs(x).max(initial=0.0)
        self._whole: np.ndarray | None = None

    def _integers(self) -> np.ndarray:
        """Unbounded integers, for components that doubles cannot multiply exactly."""
        if self._whole is None:
            self._whole = np.array([[int(c) for c in row] for row in self.x], object).reshape(self.x.shape)
        return self._whole

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, their scores, rows scored): among them the ``k`` best allowed rows of each closed window, by score and row."""
        n, width = self.x.shape
        exact = self.largest * np.abs(anchor).max(initial=0.0) * width < _EXACT
        x, a = (self.x, anchor) if exact else (self._integers(), np.array([int(c) for c in anchor], object))
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, x.dtype)
        open_windows, depth, scored = list(windows), 0, 0
        while depth < n and scored < n and open_windows:
            before, depth = depth, min(n, max(FIRST_DEPTH, 2 * depth))
            now = met.copy()
            now[self.order[n - depth: n - before, up].ravel()] = True
            now[self.order[before:depth, down].ravel()] = True
            if not len(up) and not len(down):
                now[:] = True  # every score is zero
            fresh = np.flatnonzero(now & ~met)
            met = now
            scored += len(fresh)
            fresh = fresh[allowed[fresh]]
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, x[fresh] @ a])
            top, bottom = self.values[n - depth, up], self.values[depth - 1, down]
            if not exact:
                top, bottom = (np.array([int(c) for c in v], object) for v in (top, bottom))
            threshold = (top * a[up]).sum() + (bottom * a[down]).sum()
            open_windows = [w for w in open_windows if not self._closed(scores, threshold, w, k)]
        inside = np.zeros(len(rows), bool)
        for lo, hi in windows:
            at = np.flatnonzero((scores >= lo) & (scores <= hi))
            inside[at[np.lexsort((rows[at], -scores[at]))[:k]] if exact else sorted(at, key=lambda i: (-scores[i], rows[i]))[:k]] = True
        return rows[inside], scores[inside], scored

    @staticmethod
    def _closed(scores: np.ndarray, threshold, window: tuple[float, float], k: int) -> bool:
        if threshold < window[0]:
            return True
        held = scores[(scores >= window[0]) & (scores <= window[1])]
        return len(held) >= k and threshold < np.sort(held)[-k]


def _clamped(scores: np.ndarray) -> list[int]:
    return [max(-_LONG - 1, min(_LONG, int(s))) for s in scores]


def window_of(score: int, low: int = 50, high: int = 95) -> tuple[int, int]:
    """Integer scores from ``low`` to ``high`` per cent of ``score``."""
    return -((-low * score) // 100), (high * score) // 100


def _sorted_chunk(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = t["of"].to_numpy(), t["class"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order], _matrix(t["x"], width)[order]


def _positives(width: int, k: int):
    """Per anchor the ``k`` best rows of its label in a chunk."""
    def solve(anchors: pa.Table, chunk: pa.Table) -> pa.Table:
        ids, labels, x = _sorted_chunk(chunk, width)
        a = _matrix(anchors["v"], width)
        row, own, mine = (anchors[c].to_numpy() for c in ("row", "vec_id", "label"))
        found: list[tuple[int, int, int]] = []
        for label in np.unique(mine):
            of = np.flatnonzero(labels == label)
            lists = Lists(x[of])
            for i in np.flatnonzero(mine == label) if len(of) else ():
                at, scores, _ = lists.search(a[i], ids[of] != own[i], [(-np.inf, np.inf)], k)
                found += zip([row[i]] * len(at), ids[of][at], _clamped(scores), strict=True)
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "positive_id", "positive_score"), columns, strict=True)})
    return solve


def _negatives(width: int, k: int, low: int, high: int):
    """Per anchor and positive the ``k`` best rows of other labels in a chunk, within the positive's window."""
    names = ("row", "anchor_id", "turn", "positive_id", "positive_score", "negative_id", "negative_score")

    def solve(anchors: pa.Table, chunk: pa.Table) -> pa.Table:
        ids, labels, x = _sorted_chunk(chunk, width)
        a = _matrix(anchors["v"], width)
        lists = Lists(x)
        found: list[tuple[int, ...]] = []
        for i, (row, own, mine, positives) in enumerate(zip(*(anchors[c].to_pylist() for c in ("row", "vec_id", "label", "positives")), strict=True)):
            windows = [window_of(p["positive_score"], low, high) for p in positives]
            windows = [(w, p) for w, p in zip(windows, positives, strict=True) if w[0] <= w[1]]
            at, scores, _ = lists.search(a[i], (ids != own) & (labels != mine), [w for w, _ in windows], k)
            scores = _clamped(scores)
            for (lo, hi), p in windows:
                best = sorted((-s, ids[j]) for j, s in zip(at, scores, strict=True) if lo <= s <= hi)[:k]
                found += [(row, own, p["turn"], p["positive_id"], p["positive_score"], j, -s) for s, j in best]
        columns = list(zip(*found, strict=True)) if found else [()] * 7
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})
    return solve


def mine(vectors: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on ``vec_id``. Every row is searched; the vectors travel once per block of
    anchors and the anchors once per chunk of rows, as 32-bit integers where they fit.
    """
    data = materialize(usable(vectors, label).withColumn("row", F.monotonically_increasing_id()))
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    stats = data.agg(F.max(F.size("v")).alias("width"), F.max(largest).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(anchors).alias("m")).first()
    width = max(stats["width"] or 1, 1)
    n, m = stats["n"], stats["m"]
    spread = min(data.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL_CHUNK))
    chunks, blocks = max(1, spread, -(-n * width // CHUNK_CELLS)), max(1, -(-m * width // BLOCK_CELLS))
    kind = "int" if (stats["top"] or 0) < float(1 << 31) else "double"
    data = data.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    own = [F.col(c).alias(name) for c, name in (("vec_id", "of"), ("label", "class"), ("v", "x"))]
    dealt = data.select(*own, F.pmod(F.xxhash64("row", F.lit(3)), F.lit(chunks)).cast("int").alias("chunk"), every(blocks, "block"))
    asked = data.where(anchors).withColumn("block", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks)).cast("int"))
    at = ["block", "chunk"]

    def meet(questions: DataFrame, solve, schema: str) -> DataFrame:
        return questions.select("*", every(chunks, "chunk")).groupBy(*at).cogroup(dealt.groupBy(*at)).applyInArrow(solve, schema)

    near = meet(asked, _positives(width, positives), "row long, positive_id long, positive_score long")
    best = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= positives)
    held = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_id", "positive_score"))).alias("positives"))
    held = materialize(held).withColumnRenamed("row", "_row")
    windows = asked.join(held, F.col("row") == F.col("_row")).drop("_row")
    names = "row long, anchor_id long, turn long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = meet(windows, _negatives(width, negatives, low, high), names)
    hardest = Window.partitionBy("row", "turn").orderBy(F.col("negative_score").desc(), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
