"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors become integers, ``floor(256 x)``. With one more coordinate that lifts all
data vectors to the same length, the largest inner product is the smallest
distance, so the triangle inequality holds. Queries and data are put into cells by their
pivots; from the distances kept for each cell follows how far the k-th
neighbour of any query of a cell can be. Neighbouring query cells form groups of about a block of
queries, and each data vector goes only to the groups it may matter for, so it is copied at most
once per block of queries; queries go only to the data cells their group reaches. There, blocks are solved by
matrix products that are exact, and partial lists are merged.

Defined results: vectors that are NULL or hold NULL or non-finite components take
no part, nor do those whose scaled components overflow. Shorter vectors count as
filled up with zeros. NULL ids take no part. Repeated equal rows count once; rows
of one id with other vectors are all that query's own. Ties go to the smaller
id, scores are clamped to 64 bits. An empty table gives an empty result. Extra
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.session import materialize

SCALE = 256
#: pivots, at most, and rows they are chosen from: both reach the driver
PIVOTS, PIVOT_SAMPLE = 64, 2048
#: queries per block and data rows per chunk: what a task holds at once
QUERY_BLOCK, DATA_CHUNK = 2048, 1 << 15
_EXACT = float(1 << 53)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    count = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and integer components (as doubles) of the vectors that take part, once each."""
    sizes = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    real = F.transform("embedding", lambda x: x.cast("double") * scale)
    usable = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 62))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), sizes.alias("v")).dropDuplicates(["vec_id", "v"])


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those before."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _groups(sizes: dict[int, int], between: np.ndarray) -> list[list[int]]:
    """Query cells put together, nearest first, until a group holds a block of queries."""
    left, out = set(sizes), []
    while left:
        first = min(left, key=lambda c: (-sizes[c], c))
        own, total = [], 0
        for c in sorted(left, key=lambda c: (between[first, c], c)):
            if own and total + sizes[c] > QUERY_BLOCK:
                break
            own.append(c)
            total += sizes[c]
        left -= set(own)
        out.append(own)
    return out


def search(vectors: DataFrame, queries, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows of each query (``queries``: a condition)."""
    data = materialize(scaled(vectors))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = data.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("norm"), F.count(F.lit(1)).alias("n")).first()
    width, top, n = stats["width"] or 1, stats["norm"] or 0.0, stats["n"]
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow()

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])

    pivots = _pivots(lifted(_matrix(sample["v"], width)))

    def summarise(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("v"), width)
                d = _distances(np.column_stack([x, np.zeros(len(x))]) if is_query else lifted(x), pivots)
                cell = d.argmin(1) if len(x) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])],
                                                 names=["vec_id", "v", "cell", "far"])
        return run

    celled = "vec_id long, v array<double>, cell int, far double"
    asked = materialize(data.where(queries).mapInArrow(summarise(True), celled))
    placed = materialize(data.mapInArrow(summarise(False), celled))
    # a query's own rows do not count, and an id may have several
    own = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    rank = k + own
    # summaries: that many smallest distances of each data cell, radius and size of each query cell; both bounded by the pivots
    order = Window.partitionBy("cell", "part").orderBy("far")
    near = placed.select("cell", "far", F.pmod(F.hash("vec_id"), F.lit(64)).alias("part")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= rank)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("r") <= rank).select("cell", "far").collect()
    cells = asked.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    between = _distances(pivots, pivots)
    slack = 1e-6 * (1 + top) ** 0.5 + 1e-3
    radius = {c["cell"]: c["radius"] + slack for c in cells}
    bound = {}
    for c, r in radius.items():
        reach = sorted(r + between[c, x["cell"]] + x["far"] for x in near)
        bound[c] = reach[rank - 1] + slack if len(reach) >= rank else np.inf
    # what a data cell holds: rows, nearest and farthest; a row per cell
    held = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()}
    parts = {c: -(-r["n"] // DATA_CHUNK) for c, r in held.items()}
    groups = _groups({c["cell"]: c["n"] for c in cells}, between)
    blocks = [-(-sum(c["n"] for c in cells if c["cell"] in g) // QUERY_BLOCK) for g in groups]
    kind = "int" if top < float(1 << 62) else "double"
    keys = f"grp int, block int, cell int, part int, vec_id long, v array<{kind}>"

    def reaches(query_cell: int, cell, lo, hi):
        """Whether rows of a data cell between two distances from its pivot may be among a query's nearest."""
        apart = between[query_cell, cell]
        gap = np.maximum(np.maximum(lo - apart, apart - hi), 0)
        return gap - radius[query_cell] <= bound[query_cell]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies of data rows for the groups of queries whose bounds they may be within."""
        for b in batches:
            cell, far = b.column("cell").to_numpy(), b.column("far").to_numpy()
            for g, own in enumerate(groups):
                near_enough = np.flatnonzero(np.logical_or.reduce([reaches(c, cell, far, far) for c in own]))
                rows, m = b.select(["cell", "part", "vec_id", "v"]).take(pa.array(near_enough)), len(near_enough)
                for block in range(blocks[g] if m else 0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, g, np.int32)), pa.array(np.full(m, block, np.int32)), *rows.columns],
                                                     names=["grp", "block", "cell", "part", "vec_id", "v"])

    of_cell = lambda values: F.element_at(F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, v)]) if values else F.lit(None).cast("map<int,int>"), F.col("cell"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), of_cell(parts)).cast("int").alias("part")
    dealt = placed.select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v"), "cell", "far", part).mapInArrow(deal, keys)
    group_of = {c: g for g, own in enumerate(groups) for c in own}
    grp = of_cell(group_of)
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.element_at(F.array(*[F.lit(b) for b in blocks or [1]]), grp + 1))
    # data cells that a group reaches, and into how many chunks they are cut; a row per two cells at most
    met = [(g, c, parts[c]) for g, own in enumerate(groups) for c, r in held.items() if any(reaches(q, c, r["lo"], r["hi"]) for q in own)]
    chunks = vectors.sparkSession.createDataFrame(met, "_grp int, at_cell int, parts int")
    chunks = chunks.select("_grp", "at_cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    located = asked.select(grp.cast("int").alias("grp"), block.cast("int").alias("block"), "vec_id", F.col("v").cast(f"array<{kind}>").alias("v"))
    spread = located.join(chunks, F.col("grp") == F.col("_grp")).select("grp", "block", F.col("at_cell").alias("cell"), "part", "vec_id", "v")

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        return _best(q["vec_id"].to_numpy(), _matrix(q["v"], width), x["vec_id"].to_numpy(), _matrix(x["v"], width), k)

    at = ["grp", "block", "cell", "part"]
    partial = spread.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInArrow(solve, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> pa.Table:
    """The k best rows of a chunk for each query of a block."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    if len(x) and len(q) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= _EXACT:
        return _best_of_any_size(q_ids, q, x_ids, x, k)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q_ids), 128):
        score = q[lo: lo + 128] @ x.T
        for i, s in enumerate(score):
            s[x_ids == q_ids[lo + i]] = -np.inf
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                at = np.flatnonzero(s >= least)
            else:
                at = np.arange(len(s))
            at = at[np.isfinite(s[at])]
            at = at[np.lexsort((x_ids[at], -s[at]))[:k]]
            out.append((np.full(len(at), q_ids[lo + i]), x_ids[at], s[at].astype(np.int64)))
    cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})


def _best_of_any_size(q_ids, q, x_ids, x, k) -> pa.Table:
    """As above with unbounded integers, for components that doubles cannot multiply exactly."""
    whole = [[int(c) for c in row] for row in x]
    rows = []
    for i, row in zip(q_ids.tolist(), q, strict=True):
        own = [int(c) for c in row]
        scores = [(-sum(a * b for a, b in zip(own, other, strict=True)), j) for j, other in zip(x_ids.tolist(), whole, strict=True) if j != i]
        clamped = sorted((max(1 - (1 << 63), min(1 << 63, s)), j) for s, j in scores)
        rows += [(i, j, -s) for s, j in clamped[:k]]
    ids, near, score = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.int64())})
