"""Random forests over packed blocks of binned rows, for tables too large for Spark ML's row objects.

The method is that of Spark ML's ``RandomForestClassifier``: candidate splits from a sample, a Poisson(1) number of copies of each row
per tree, for each node a random choice of the features, Gini gains, pruning of siblings that predict the same. Each level of all
trees is one job: tasks sum the copies per tree, node, label and bin, sums are added per tree by a shuffle, and only
sums over all rows reach the driver. Below the root only the rows of each node's smaller child are summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from tidemark.operators.boosting import (
    BINS, CHUNK_ROWS, Block, BlockModel, Tree, both_sides, cells_of, features_per_node, packed, placed, sampled_splits, smaller_sides, unpacked,
)

#: MB of the sums that a task holds at once; more trees than fit are grown one group after the other
SUMS_MB = 64


def copies_by_draw() -> np.ndarray:
    """Copies of a row for each 16-bit draw: Poisson(1), each probability to 1 in 65,536."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(upto, (np.arange(2**16) + 0.5) / 2**16).astype(np.uint8)


def draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """A 16-bit draw for each row of a block."""
    return np.random.default_rng((seed, tree, block)).integers(0, 2**64, n // 4 + 1, np.uint64).view(np.uint16)[:n]


def tree_sums(
    blocks: Iterator[Block], trees: dict[int, Tree], level: int, smaller: dict[int, np.ndarray], width: int, seed: int, bootstrap: bool
) -> Iterator[tuple[int, np.ndarray]]:
    """(tree, copies per (feature, node, label, bin)) of a task's rows: of the root, below it of the smaller child of each node above."""
    nodes = max(1, 2**level // 2)
    size = nodes * 2 * BINS
    sums = {t: np.zeros(width * size) for t in trees}
    answers = {t: tree.answers(level) for t, tree in trees.items()}
    cell_room, weight_room = np.empty((CHUNK_ROWS, width), np.intp), np.empty((CHUNK_ROWS, width))  # large arrays are dear to allocate
    summed = {t: np.arange(2**level) % 2 == smaller[t].repeat(2) for t in trees} if level else {}
    by_draw, some = copies_by_draw(), False
    for block, codes, y, _ in blocks:
        some = True
        copies = {t: by_draw.take(draws(seed, t, block, len(y))) if bootstrap else np.ones(len(y), np.uint8) for t in trees}
        for a, own, cells in cells_of(codes, np.where(y > 0, BINS, 0), width, size):
            for t in trees:
                mine = copies[t][a:a + CHUNK_ROWS]
                if level:
                    node = placed(answers[t], level, own)
                    rows = np.flatnonzero(summed[t].take(node) & mine.astype(bool))
                else:
                    rows = np.flatnonzero(mine)
                cell = cells.take(rows, axis=0, out=cell_room[:len(rows)], mode="clip")
                if level:
                    cell += (node.take(rows) >> 1).astype(np.intp)[:, None] * (2 * BINS)
                weights = weight_room[:len(rows)]
                weights[:] = mine.take(rows)[:, None]
                sums[t] += np.bincount(cell.ravel(), weights.ravel(), width * size)
    if some:
        for t, found in sums.items():
            yield t, found.astype(np.int64).reshape(width, nodes, 2, BINS)


def gini(positives: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = positives / n
    q = (n - positives) / n
    return 1.0 - q * q - p * p


def grow(tree: Tree, level: int, sums: np.ndarray, splits: list[np.ndarray], allowed: np.ndarray) -> None:
    """Split the nodes of a level by their (feature, node, label, bin) copies; values are shares of label 1."""
    n, p = sums[0].sum((1, 2)), sums[0, :, 1].sum(-1)
    left = sums.cumsum(-1)
    left_n, left_p = left.sum(2), left[:, :, 1]
    right_n, right_p = n[:, None] - left_n, p[:, None] - left_p
    with np.errstate(divide="ignore", invalid="ignore"):
        part = left_n / n[:, None]
        gains = gini(p, n)[:, None] - part * gini(left_p, left_n) - right_n / n[:, None] * gini(right_p, right_n)
    is_split = np.arange(BINS) < np.array([len(x) for x in splits])[:, None, None]
    gains = np.where(is_split & allowed[:, :, None] & (left_n > 0) & (right_n > 0), gains, -1.0)
    for k in range(2**level):
        i = 2**level - 1 + k
        if level == 0:
            tree.value[0] = p[0] / max(n[0], 1)
        below = [2 * i + 1, 2 * i + 2]
        f, b = np.unravel_index(gains[:, k].argmax(), gains[:, k].shape)
        if (level == 0 or tree.feature[(i - 1) // 2] >= 0) and gains[f, k, b] > 0:
            tree.feature[i], tree.split[i], tree.gain[i] = f, b, gains[f, k, b] * n[k]
            tree.value[below] = left_p[f, k, b] / left_n[f, k, b], right_p[f, k, b] / right_n[f, k, b]
        else:
            tree.value[below] = tree.value[i]


def prune(tree: Tree) -> None:
    """Take back splits whose sides are leaves that predict the same label, from the bottom up."""
    inner = 2**tree.depth - 1
    is_leaf = lambda i: i >= inner or tree.feature[i] < 0
    for i in reversed(range(inner)):
        below = [2 * i + 1, 2 * i + 2]
        if tree.feature[i] >= 0 and all(map(is_leaf, below)) and (tree.value[below[0]] > 0.5) == (tree.value[below[1]] > 0.5):
            tree.feature[i], tree.gain[i] = -1, 0.0
    for i in range(inner):
        if tree.feature[i] < 0:
            tree.value[[2 * i + 1, 2 * i + 2]] = tree.value[i]


class ForestModel(BlockModel):
    """Trees that vote with their shares of label 1."""

    @property
    def featureImportances(self):  # noqa: N802 - the name that Spark ML's models have
        total = np.zeros(len(self.splits))
        for t in self.trees:
            if t.gain.sum():
                np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0] / t.gain.sum())
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def positives(self, x: np.ndarray) -> np.ndarray:
        return self.margins(x)


def fit_forest(
    train: DataFrame, label: str, rows: int, trees: int, depth: int, seed: int = 42, bootstrap: bool = True, features: int | None = None
) -> ForestModel:
    """A forest of ``train`` (features, label) with ``rows`` rows; ``features`` of them, by default the square root, for each node."""
    sc = train.sparkSession.sparkContext
    splits = sampled_splits(train, rows, seed)
    width = len(splits)
    features = features or math.ceil(math.sqrt(width))
    blocks = packed(train, label, splits).repartitionByRange(sc.defaultParallelism, "block")  # the same number of blocks for each
    state = blocks.rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    at_once = max(1, SUMS_MB * 2**20 // (2**max(depth - 2, 0) * 2 * BINS * 8 * width))
    grown = {}
    for first in range(0, trees, at_once):
        group = {t: Tree.empty(depth) for t in range(first, min(first + at_once, trees))}
        sums, smaller = {}, {}
        for level in range(depth):
            found = dict(state.mapPartitions(  # one row a tree, whatever the number of rows
                lambda part, g=group, at=level, side=smaller: tree_sums(part, g, at, side, width, seed, bootstrap)
            ).reduceByKey(np.add, sc.defaultParallelism).collect())
            for t, tree in group.items():
                by_node = found[t] if not level else np.stack([both_sides(smaller[t], found[t][:, :, c], sums[t][:, :, c]) for c in (0, 1)], 2)
                grow(tree, level, by_node, splits, features_per_node(seed, t, level, width, features))
                sums[t], smaller[t] = by_node, smaller_sides(tree, level, by_node.sum(2))
        for tree in group.values():
            prune(tree)
        grown |= group
    state.unpersist()
    return ForestModel([grown[t] for t in range(trees)], [1.0 / trees] * trees, splits)
