"""Deterministic sampling and folds, exact ranking metrics, bootstrap intervals, agreement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.ordered import exact_quantiles, positions, running
from tidemark.functions.reshape import long_form
from tidemark.functions.session import materialize

#: cumulative distribution of a Poisson(1) count, as far as a 32-bit hash can tell
POISSON_1_CDF = tuple(accumulate(exp(-1) / factorial(k) for k in range(13)))


def hash_key(columns: Sequence[str | Column], seed: int) -> Column:
    """Reproducible pseudo-random text; depends only on the values and the seed."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def hash_int(columns: Sequence[str | Column], seed: int) -> Column:
    """The first 32 bits of the hash as a number."""
    return F.conv(F.substring(hash_key(columns, seed), 1, 8), 16, 10).cast("long")


def hash_unit(columns: Sequence[str | Column], seed: int) -> Column:
    return hash_int(columns, seed) / F.lit(float(2**32))


#: leading hexadecimal digits of the hash by which rows are counted before any are ordered
PREFIX = 3


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hash of their (unique) key.

    Rows are counted by the first digits of their hash (a table of fixed size); all below the
    prefix in which the count passes ``n`` are in, and only the rows of that prefix are ordered.
    """
    keyed = df.select(key, hash_key([key], seed).alias("_h")).withColumn("_p", F.substring("_h", 1, PREFIX))
    before, crossing = 0, None
    for r in keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
        if before + r["n"] > n:
            crossing = r["_p"]
            break
        before += r["n"]
    if crossing is None:
        return df
    rest = keyed.where(F.col("_p") == crossing).orderBy("_h", key).limit(n - before)
    return df.join(keyed.where(F.col("_p") < crossing).unionByName(rest).select(key), key, "left_semi")


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows with the class shares of the whole; each share is rounded half up.

    As in ``sample``, rows are ordered only in the one prefix per stratum in which its count passes its share.
    """
    keyed = df.select(key, F.col(stratum).alias("_s"), hash_key([key], seed).alias("_h")).withColumn("_p", F.substring("_h", 1, PREFIX))
    counts = materialize(keyed.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    own = Window.partitionBy("_s")
    below = own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    share = F.floor(F.lit(float(n)) * F.sum("_n").over(own) / F.lit(total) + 0.5)
    # at most 16 ** PREFIX rows per stratum; written, so that the join is a plain shuffle of both sides
    cut = materialize(counts.select("_s", "_p", (share - F.coalesce(F.sum("_n").over(below), F.lit(0))).alias("_room"), "_n").where("_room > 0"))
    inside = keyed.join(cut, ["_s", "_p"])
    crossing = inside.where(F.col("_n") > F.col("_room"))
    ranked = positions(crossing.select(key, "_s", "_h", "_room"), ["_s"], [F.col("_h"), F.col(key)])
    chosen = inside.where(F.col("_n") <= F.col("_room")).select(key).unionByName(ranked.where(F.col("position") <= F.col("_room")).select(key))
    return df.join(chosen, key, "left_semi")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold): equal class shares, by dealing out each class in hash order."""
    keyed = df.select(key, F.col(label).alias("_s"), hash_key([key], seed).alias("_h"))
    ranked = positions(keyed, ["_s"], [F.col("_h"), F.col(key)])
    return ranked.select(key, ((F.col("position") - 1) % k).cast("int").alias("fold"))


def group_fold(group: str, k: int = 5, seed: int = 42) -> Column:
    """Fold number of a group: all its rows share it; sizes are equal only on average."""
    return (hash_int([group], seed) % k).cast("int")


def in_test(group: str, test_size: float = 0.2, seed: int = 42) -> Column:
    return hash_unit([group], seed) < test_size


def ranking_metrics(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact AUROC and average precision per group, ties included, weights optional.

    Rows collapse to one per distinct score first; one running sum over the
    scores then gives both metrics. Without both classes AUROC is NULL; without
    positives average precision is 0. Rows without score or label do not count.
    """
    df = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    per_score = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(w * y).alias("_p"), F.sum(w * (1 - y)).alias("_q"))
    keys = list(by)
    if not keys:
        per_score, keys = per_score.withColumn("_all", F.lit(0)), ["_all"]
    scanned = running(
        per_score, keys, [F.col("_s")], {"_cp": ("sum", F.col("_p")), "_cq": ("sum", F.col("_q"))}, totals=True
    ).withColumnsRenamed({"_cp_total": "_tp", "_cq_total": "_tq"})
    # scores at or above this one, i.e. predicted positive at this cut
    pos_above = F.col("_tp") - F.col("_cp") + F.col("_p")
    neg_above = F.col("_tq") - F.col("_cq") + F.col("_q")
    wins = F.col("_p") * (F.col("_cq") - F.col("_q") + 0.5 * F.col("_q"))
    precision = F.col("_p") * F.try_divide(pos_above, pos_above + neg_above)
    out = (
        scanned.groupBy(*keys)
        .agg(
            F.max("_tp").alias("n_pos"), F.max("_tq").alias("n_neg"),
            F.sum(wins).alias("_wins"), F.sum(precision).alias("_ap"),
        )
        .select(
            *keys, "n_pos", "n_neg",
            F.try_divide(F.col("_wins"), F.col("n_pos") * F.col("n_neg")).alias("auroc"),
            F.coalesce(F.try_divide("_ap", "n_pos"), F.lit(0.0)).alias("average_precision"),
        )
    )
    return out if by else out.drop("_all")


def threshold_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Brier score and the confusion-based metrics at one threshold, over rows with score and label.

    ``n_left_out`` counts the others.
    """
    whole = F.col(score).isNotNull() & F.col(label).isNotNull()
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    counts = df.groupBy(*by).agg(
        F.count_if(whole).alias("n"), F.count_if(~whole).alias("n_left_out"),
        F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"),
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select(
        *by, "n", "n_left_out", "tp", "fp", "fn", "tn", "brier",
        zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"),
        zero(2 * tp, 2 * tp + fp + fn).alias("f1"), zero(tn, tn + fp).alias("specificity"),
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, minimum and maximum over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return folds.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_folds"))


def poisson_weight(cluster: str | Column, replicate: str, seed: int) -> Column:
    """How often a cluster is drawn in a replicate: Poisson(1) from its hash."""
    u = hash_unit([cluster, replicate], seed)
    w = F.lit(0)
    for c in POISSON_1_CDF:
        w = w + (u >= c).cast("int")
    return w


def cluster_draws(clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(``_k``, ``_draws``): how often each cluster is drawn in each replicate, a byte each; ``poisson_weight`` for all replicates at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = [f":{r}:{seed}".encode() for r in range(1, replicates + 1)]
        for batch in batches:
            draws = []
            for name in batch.column("_name").to_pylist():
                # concat_ws leaves out what is NULL, and the separator with it
                start = hashlib.md5((name or "").encode())
                heads = []
                for tail in tails:
                    h = start.copy()
                    h.update(tail if name is not None else tail[1:])
                    heads.append(h.digest()[:4])
                u = np.frombuffer(b"".join(heads), ">u4") / 2.0**32
                draws.append((u[:, None] >= np.array(POISSON_1_CDF)).sum(1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(draws, pa.binary())], names=["_k", "_draws"])

    named = clusters.select("_k", F.col("_k").cast("string").alias("_name"))
    return materialize(named.mapInArrow(run, T.StructType([clusters.schema["_k"], T.StructField("_draws", T.BinaryType())])))


def _draw_matrix(batch: pa.RecordBatch, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of positives and of negatives, a row per cell and a column per replicate."""
    draws = np.frombuffer(b"".join(batch.column("_draws").to_pylist()), np.uint8).reshape(-1, replicates)
    w = draws * batch.column("_m").to_numpy()[:, None].astype(float)
    y = batch.column("_y").to_numpy()[:, None]
    return w * y, w * (1 - y)


def bootstrap_replicates(
    df: DataFrame, cluster: str, score: str, label: str, replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """AUROC and average precision per bootstrap replicate.

    Clusters (subjects; or row ids for a row bootstrap) get independent
    Poisson(1) weights, the distributed form of drawing with replacement. Rows
    collapse to (cluster, score, label) counts, each with the draws of its cluster as one
    byte per replicate. The cells are dealt to ranges of the score; a task walks its
    range from the top with one vector per replicate, starting from what lies above it, and only
    sums per range and replicate travel. No cell is repeated.
    """
    spark = df.sparkSession
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    cells = materialize(known.groupBy(F.col(cluster).alias("_k"), F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_m")))
    draws = cluster_draws(cells.select("_k").distinct(), replicates, seed).withColumnRenamed("_k", "_dk")
    # ends of the ranges: as many numbers as there are partitions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(cells.approxQuantile("_s", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    part = reduce(lambda c, cut: c + (F.col("_s") > cut).cast("int"), cuts, F.lit(0)).alias("_part")
    drawn = cells.join(draws, F.col("_k").eqNullSafe(F.col("_dk"))).select(part, "_s", "_y", "_m", "_draws")
    drawn = materialize(drawn)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            p, q = _draw_matrix(batch, replicates)
            of = batch.column("_part").to_numpy()
            for k in np.unique(of).tolist():
                own = sums.setdefault(k, np.zeros((2, replicates)))
                own += np.stack([p[of == k].sum(0), q[of == k].sum(0)])
        for k, (p, q) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([p]), pa.array([q])], names=["_part", "p", "q"])

    by_part = drawn.repartition("_part").mapInArrow(totals, "_part int, p array<double>, q array<double>")
    each = by_part.select("_part", F.posexplode(F.arrays_zip("p", "q")).alias("r", "x")).select("_part", "r", "x.p", "x.q")
    each = materialize(each.groupBy("_part", "r").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    same = Window.partitionBy("r")
    higher = same.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = each.select(
        "_part", "r", F.coalesce(F.sum("p").over(higher), F.lit(0.0)).alias("pa"), F.coalesce(F.sum("q").over(higher), F.lit(0.0)).alias("qa"),
        F.sum("q").over(same).alias("qt"),
    )
    vectors = F.sort_array(F.collect_list(F.struct("r", "pa", "qa", "qt")))
    heads = above.groupBy("_part").agg(vectors.alias("_v")).select("_part", F.lit(True).alias("_head"), *[F.col(f"_v.{n}").alias(f"_{n}") for n in ("pa", "qa", "qt")])
    # a range's vectors come first, then its cells from the highest score
    stream = heads.unionByName(drawn.withColumn("_head", F.lit(False)), allowMissingColumns=True)
    stream = stream.repartition("_part").sortWithinPartitions("_part", F.col("_head").desc(), F.col("_s").desc())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Walk | None = None
        for batch in batches:
            heads_at = np.flatnonzero(batch.column("_head").to_numpy(zero_copy_only=False)).tolist()
            edges = sorted({0, *heads_at, *[h + 1 for h in heads_at], len(batch)})
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = batch.slice(lo, hi - lo)
                if lo in heads_at:
                    if state:
                        yield state.done()
                    state = _Walk(*(np.array(own.column(n)[0].as_py(), float) for n in ("_pa", "_qa", "_qt")))
                else:
                    state.add(own.column("_s").to_numpy(), *_draw_matrix(own, replicates))
        if state:
            yield state.done()

    sums = stream.mapInArrow(walk, "wins array<double>, ap array<double>")
    metrics = sums.select(F.posexplode(F.arrays_zip("wins", "ap")).alias("r", "x")).groupBy("r").agg(F.sum("x.wins").alias("_wins"), F.sum("x.ap").alias("_ap"))
    sizes = each.groupBy(F.col("r").alias("_r")).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg")).where("n_pos + n_neg > 0")
    return metrics.join(sizes, F.col("r") == F.col("_r")).select(
        (F.col("r") + 1).alias("replicate"), "n_pos", "n_neg", F.try_divide(F.col("_wins"), F.col("n_pos") * F.col("n_neg")).alias("auroc"),
        F.coalesce(F.try_divide("_ap", "n_pos"), F.lit(0.0)).alias("average_precision"),
    )


class _Walk:
    """From the highest score of a range downwards, one vector per replicate: positives and negatives so far, and both metrics' sums."""

    def __init__(self, pos: np.ndarray, neg: np.ndarray, all_neg: np.ndarray):
        self.pos, self.neg, self.all_neg = pos, neg, all_neg
        self.wins, self.ap = np.zeros(len(pos)), np.zeros(len(pos))
        self.last: tuple[float, np.ndarray, np.ndarray] | None = None  # a score may go on in the next batch

    def _settle(self, p: np.ndarray, q: np.ndarray) -> None:
        """Scores one below the other, a row each."""
        pos, neg = self.pos + np.cumsum(p, 0), self.neg + np.cumsum(q, 0)
        self.wins += (p * (self.all_neg - neg + 0.5 * q)).sum(0)
        both = pos + neg
        self.ap += np.divide(p * pos, both, out=np.zeros_like(both), where=both > 0).sum(0)
        self.pos, self.neg = pos[-1], neg[-1]

    def add(self, scores: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        first = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        p, q, scores = np.add.reduceat(p, first, 0), np.add.reduceat(q, first, 0), scores[first]
        if self.last and self.last[0] == scores[0]:
            p[0] += self.last[1]
            q[0] += self.last[2]
        elif self.last:
            self._settle(self.last[1][None], self.last[2][None])
        if len(scores) > 1:
            self._settle(p[:-1], q[:-1])
        self.last = (scores[-1], p[-1], q[-1])

    def done(self) -> pa.RecordBatch:
        if self.last:
            self._settle(self.last[1][None], self.last[2][None])
        return pa.RecordBatch.from_arrays([pa.array([self.wins]), pa.array([self.ap])], names=["wins", "ap"])


def bootstrap_ci(
    df: DataFrame, cluster: str, score: str, label: str, replicates: int = 1000, seed: int = 42, alpha: float = 0.05
) -> DataFrame:
    """(metric, point, low, high); replicates without a defined metric are skipped."""
    reps = bootstrap_replicates(df, cluster, score, label, replicates, seed)
    melted = reps.select(
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auroc", "average_precision")
        ])).alias("x")
    ).select("x.metric", "x.value").where(F.col("value").isNotNull())
    freq = melted.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    ci = exact_quantiles(freq, ["metric"], "value", "n", {"low": alpha / 2, "high": 1 - alpha / 2})
    point = long_form(
        ranking_metrics(df, score, label), {m: {"point": F.col(m)} for m in ("auroc", "average_precision")}, "metric"
    )
    return point.join(ci, "metric", "left")


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of two 0/1 labels."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 labels, with the confusion counts and prevalences."""
    x, y = F.col(a) == 1, F.col(b) == 1
    c = df.agg(
        F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"),
        F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"),
    )
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    pa, pb = F.try_divide(F.col("n11") + F.col("n10"), n), F.try_divide(F.col("n11") + F.col("n01"), n)
    agree = F.try_divide(F.col("n11") + F.col("n00"), n)
    chance = pa * pb + (1 - pa) * (1 - pb)
    return c.select(
        "n11", "n10", "n01", "n00", pa.alias("prevalence_a"), pb.alias("prevalence_b"),
        (pb - pa).alias("delta"), F.try_divide(agree - chance, 1 - chance).alias("kappa"),
    )


def missingness_delta(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing percentages of the same columns in two datasets and their difference."""
    def pct(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*[(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns])
        return long_form(wide, {c: {name: F.col(c)} for c in columns}, "column_name")

    joined = pct(a, "pct_a").join(pct(b, "pct_b"), "column_name")
    return joined.withColumn("delta", F.col("pct_b") - F.col("pct_a"))


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int = 43) -> DataFrame:
    """(key, label) with the labels permuted: the i-th key gets the label of the i-th hash."""
    slim = df.select(key, label, hash_key([key], seed).alias("_h"))
    to = positions(slim.select(key), [], [F.col(key)])
    giver = positions(slim, [], [F.col("_h"), F.col(key)]).select("position", label)
    return to.join(giver, "position").select(key, label)
