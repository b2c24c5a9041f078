import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v long, chunk int, score double"


def floor(x):
    return int(np.floor(256.0 * float(np.float32(x))))


def brute(rows, every=5, positives=5, negatives=3):
    """All scores of all pairs, for rows (vec_id, embedding, label)."""
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    kept = {(i, lab, tuple(floor(c) for c in e)) for i, e, lab in rows if None not in (i, e, lab) and None not in e and np.isfinite(np.array(e, float)).all()}
    out = []
    for i, lab, a in kept:
        if i % every:
            continue
        scored = sorted((-clamp(sum(p * q for p, q in zip(a, v, strict=False))), j, other == lab) for j, other, v in kept if j != i)
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(map(tuple, H.mine(df, F.col("label"), F.col("vec_id") % 5 == 0, **kw).collect()))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], SCHEMA)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(H, "CHUNK_CELLS", 200)
    monkeypatch.setattr(H, "BLOCK_CELLS", 60)
    monkeypatch.setattr(H, "FIRST_DEPTH", 2)


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs_agree(spark, small, seed):
    rng = random.Random(seed)
    values = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 0.3]  # many equal scores
    rows = [(i, [rng.choice(values) for _ in range(4)], rng.randrange(3)) for i in range(150)]
    got = mined(frame(spark, rows))
    assert got == brute(rows) and len(got) > 50


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    assert mined(df) == brute(rows)


def test_odd_rows(spark, small):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.5], 1), (2, [0.7, 0.7], 2), (3, [0.7, 0.7], 2), (3, [0.7, 0.7], 2),
        (4, None, 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 1), (9, [1.0, 1.0], None),
        (10, [0.5], 2), (11, [], 1), (5, [0.0, 0.0], 3), (15, [1.0, -3.0], 9), (12, [0.9, 1.2], 2), (13, [-1.0, -1.0], 2),
    ]
    pad = lambda e: e if e is None else [*e, *[0.0] * (2 - len(e))]
    got = mined(frame(spark, rows))
    assert got == brute([(i, pad(e), lab) for i, e, lab in rows]) and got
    assert mined(frame(spark, rows).limit(0)) == []
    assert mined(frame(spark, rows).where("embedding is null")) == []


def test_components_beyond_exact_doubles(spark, small):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e18, -3e12, 7.5, 1e30, 0.1]) for _ in range(3)], rng.randrange(2)) for i in range(40)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_one_vector_for_a_third_of_the_rows(spark, small):
    rng = random.Random(6)
    rows = [(i, [1.0, 0.5, 0.5] if i % 3 else [rng.random() for _ in range(3)], i % 4 if i % 2 else 0) for i in range(300)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_the_threshold_stops_early():
    rng = np.random.default_rng(1)
    x = np.floor(rng.pareto(1.5, (4000, 3)) * 10)
    lists = H.Lists(x)
    allowed = np.ones(len(x), bool)
    for anchor in (np.array([5.0, 1.0, 0.0]), np.array([1.0, -2.0, 3.0]), np.zeros(3)):
        want = x @ anchor
        rows, scores, scored = lists.search(anchor, allowed, [(-np.inf, np.inf)], 5)
        best = np.lexsort((np.arange(len(x)), -want))[:5]
        assert sorted(rows) == sorted(best) and sorted(scores) == sorted(want[best])
        assert scored < len(x) / 4 or not anchor.any()
    # a window that no score can reach is closed at once
    assert lists.search(np.array([1.0, 1.0, 1.0]), allowed, [(1e9, 2e9)], 3)[2] < 100


def test_windows_are_exact():
    assert H.window_of(100) == (50, 95) and H.window_of(3) == (2, 2) and H.window_of(0) == (0, 0)
    lo, hi = H.window_of(-100)
    assert lo > hi
