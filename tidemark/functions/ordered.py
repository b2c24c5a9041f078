"""Running aggregates, range counts and nearest rows that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole key into one
task. Here the rows are range-partitioned on (key, time) instead, so a key that
holds a third of the table is spread over a third of the partitions; each
partition is scanned locally and only one carry row per partition crosses over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.session import materialize

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def _orderable_min_max(kind: str, carry: Column, local: Column) -> Column:
    """greatest/least reject structs, so compare through sorted arrays."""
    both = F.array_compact(F.array(carry, local))
    return F.array_max(both) if kind == "max" else F.array_min(both)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    aggs: Mapping[str, tuple[str, Column]],
    partitions: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``by``, current row included.

    ``totals`` adds the aggregate of the whole group as ``<name>_total`` and its
    row count as ``n_rows``, without a join on the group: what a partition holds
    of a group is known locally, and only groups that cross a partition
    boundary need the numbers of others.

    ``aggs`` maps an output name to (``sum`` | ``min`` | ``max``, expression).
    ``order`` must be total for rows whose relative position matters.

    The range-partitioned rows are written before use: partition bounds come
    from sampling, and both the local scan and the carry must see the same ones.
    The carry has at most two rows per partition (a partition's first and last
    group), which is what bounds the broadcast.
    """
    staged = df.select("*", *[e.alias(f"_in_{name}") for name, (_, e) in aggs.items()])
    keys = [F.col(c) for c in by]
    # rows that tie on the order keys may still be split between partitions
    tie = F.xxhash64(*df.columns)
    # without a number, small ranges are coalesced at run time and stay in order
    number = [partitions] if partitions else []
    fixed = materialize(
        staged.repartitionByRange(*number, *keys, *order, tie).withColumn("_pid", F.spark_partition_id())
    )

    whole = Window.partitionBy("_pid", *by)
    local = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [_COMBINE[kind][0](f"_in_{name}").over(whole).alias(f"_own_{name}") for name, (kind, _) in aggs.items()]
    scanned = fixed.select(
        *df.columns,
        "_pid",
        *[_COMBINE[kind][0](f"_in_{name}").over(local).alias(name) for name, (kind, _) in aggs.items()],
        *([*own, F.count(F.lit(1)).over(whole).alias("_own_rows")] if totals else []),
    )

    per_part = fixed.groupBy("_pid", *by).agg(
        *[_COMBINE[kind][0](f"_in_{name}").alias(name) for name, (kind, _) in aggs.items()],
        F.count(F.lit(1)).alias("_rows"),
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = [_COMBINE[kind][0](name).over(group).alias(f"_all_{name}") for name, (kind, _) in aggs.items()]
    carry = (
        per_part.select(
            F.col("_pid").alias("_cpid"),
            *[F.col(c).alias(f"_c_{c}") for c in by],
            F.count(F.lit(1)).over(group).alias("_parts"),
            *[
                _COMBINE[kind][0](name).over(before).alias(f"_carry_{name}")
                for name, (kind, _) in aggs.items()
            ],
            *([*everything, F.sum("_rows").over(group).alias("_all_rows")] if totals else []),
        )
        .where("_parts > 1")
        .drop("_parts")
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col("_pid") == F.col("_cpid"), *[F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by]],
    )
    joined = scanned.join(F.broadcast(carry), same, "left")
    out = []
    for name, (kind, _) in aggs.items():
        c, l = F.col(f"_carry_{name}"), F.col(name)
        out.append(
            (_COMBINE["sum"][1](c, l) if kind == "sum" else _orderable_min_max(kind, c, l)).alias(name)
        )
    if totals:
        crosses = F.col("_cpid").isNotNull()
        out += [F.when(crosses, F.col(f"_all_{name}")).otherwise(F.col(f"_own_{name}")).alias(f"{name}_total") for name in aggs]
        out.append(F.when(crosses, F.col("_all_rows")).otherwise(F.col("_own_rows")).alias("n_rows"))
    return joined.select(*df.columns, *out)


@dataclass(frozen=True)
class RangeCount:
    """Count the rows of one fact source with lo (<|<=) time (<|<=) hi."""

    facts: str
    lo: Column
    hi: Column
    lo_closed: bool = True
    hi_closed: bool = False


def range_counts(
    anchors: DataFrame,
    anchor_id: str,
    key: str,
    facts: Mapping[str, tuple[DataFrame, str]],
    counts: Mapping[str, RangeCount],
) -> DataFrame:
    """Per anchor, how many facts of the same key fall into each range.

    Facts and range ends are merged into one sorted sequence; a count is the
    difference of two running totals. Cost is linear in anchors plus facts,
    where a range join would produce every (anchor, fact) pair of a busy key.
    """
    names = list(facts)
    # one row per (key, time): copies of a fact never travel through the sort
    rows = [
        df.where(F.col(t).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.col(t).alias("_t"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_key", "_t",
            F.lit(1).alias("_rank"),
            F.lit(None).cast(dict(anchors.dtypes)[anchor_id]).alias("_id"),
            F.lit(None).cast("string").alias("_probe"),
            *[(F.col("_n") if n == name else F.lit(0).cast("long")).alias(f"_n_{n}") for n in names],
        )
        for name, (df, t) in facts.items()
    ]
    # An open lower end and a closed upper end also count facts at that very
    # time, so those probes sort after the facts.
    probes = []
    for name, c in counts.items():
        probes.append(F.struct(c.lo.alias("t"), F.lit(0 if c.lo_closed else 2).alias("r"), F.lit(f"{name}/lo").alias("p")))
        probes.append(F.struct(c.hi.alias("t"), F.lit(2 if c.hi_closed else 0).alias("r"), F.lit(f"{name}/hi").alias("p")))
    probe_rows = (
        anchors.select(F.col(key).alias("_key"), F.col(anchor_id).alias("_id"), F.explode(F.array(*probes)).alias("_x"))
        .select("_key", F.col("_x.t").alias("_t"), F.col("_x.r").alias("_rank"), "_id", F.col("_x.p").alias("_probe"),
                *[F.lit(0).cast("long").alias(f"_n_{n}") for n in names])
    )
    merged = reduce(DataFrame.unionByName, [*rows, probe_rows])
    scanned = running(
        merged,
        ["_key"],
        [F.col("_t"), F.col("_rank")],
        {f"_cum_{n}": ("sum", F.col(f"_n_{n}")) for n in names},
    )
    return (
        scanned.where(F.col("_probe").isNotNull())
        .groupBy(F.col("_id").alias(anchor_id))
        .agg(
            *[
                (
                    F.sum(F.when(F.col("_probe") == f"{name}/hi", F.col(f"_cum_{c.facts}")))
                    - F.sum(F.when(F.col("_probe") == f"{name}/lo", F.col(f"_cum_{c.facts}")))
                ).alias(name)
                for name, c in counts.items()
            ]
        )
    )


def next_at_or_after(
    anchors: DataFrame,
    anchor_id: str,
    key: str,
    start: str,
    facts: DataFrame,
    time: str,
    payload: Sequence[str],
) -> DataFrame:
    """Per anchor, the earliest fact of its key with ``time >= start``.

    Ties on time go to the smallest payload. Anchors without such a fact get a
    NULL ``nearest``.
    """
    fact_type = F.struct(F.col(time).alias("time"), *[F.col(c) for c in payload])
    f = facts.where(F.col(time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_rank"), fact_type.alias("_fact")
    ).distinct()
    a = anchors.select(
        F.col(key).alias("_key"), F.col(start).alias("_t"), F.lit(0).alias("_rank"), F.col(anchor_id).alias("_id")
    )
    merged = f.unionByName(a, allowMissingColumns=True)
    scanned = running(
        merged, ["_key"], [F.col("_t").desc(), F.col("_rank").desc()], {"nearest": ("min", F.col("_fact"))}
    )
    return scanned.where(F.col("_rank") == 0).select(F.col("_id").alias(anchor_id), "nearest")


def last_at_or_before(
    facts: DataFrame, key: str, time: str, anchors: DataFrame, start: str, payload: Sequence[str]
) -> DataFrame:
    """Attach to each fact the latest anchor of its key with ``start <= time``.

    Adds the struct column ``anchor``; facts before the first anchor get NULL.
    """
    anchor_type = F.struct(F.col(start).alias("time"), *[F.col(c) for c in payload])
    a = anchors.select(
        F.col(key), F.col(start).alias(time), F.lit(0).alias("_rank"), anchor_type.alias("_anchor")
    )
    merged = facts.withColumn("_rank", F.lit(1)).unionByName(a, allowMissingColumns=True)
    scanned = running(merged, [key], [F.col(time), F.col("_rank")], {"anchor": ("max", F.col("_anchor"))})
    return scanned.where(F.col("_rank") == 1).drop("_rank", "_anchor")


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based row number within ``by``, without gathering a group in one task."""
    return running(df, by, order, {name: ("sum", F.lit(1).cast("long"))})


def exact_quantiles(
    freq: DataFrame, by: Sequence[str], value: str, count: str, probs: Mapping[str, float], sizes: bool = False
) -> DataFrame:
    """Linear-interpolation quantiles from (by, value, count) rows.

    The frequency rows are walked with running counts, so the distinct values of
    one group never have to fit into a single task. ``sizes`` adds the number of
    values and of distinct values.
    """
    if not by:
        return exact_quantiles(freq.withColumn("_all", F.lit(0)), ["_all"], value, count, probs, sizes).drop("_all")
    keys = list(by)
    joined = running(
        freq.where(F.col(value).isNotNull()), keys, [F.col(value)], {"_cum": ("sum", F.col(count).cast("long"))}, totals=True
    ).withColumnsRenamed({"_cum_total": "_total", "n_rows": "_distinct"})
    aggs, out = [], []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            covers = (F.col("_cum") - F.col(count) <= at) & (at < F.col("_cum"))
            aggs.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * F.col(f"_{name}_w")).alias(name))
    if sizes:
        aggs += [F.max("_total").alias("n_values"), F.max("_distinct").alias("n_distinct")]
        out += [F.col("n_values"), F.col("n_distinct")]
    return joined.groupBy(*keys).agg(*aggs).select(*keys, *out)
