"""Mixing sources to target weights by capped water-filling.

Each source gets words in proportion to its weight, but never more than
``max_epochs`` times what it has; the excess goes to the others in proportion
to their weights until none is above. Sources sorted by cap over weight are
filled in turn, so the common level follows from running sums. Within a source
every document is repeated a whole number of times; the fraction left is
taken from the documents in a seeded hash order, up to the target.

Only DataFrame functions. Defined results: NULL text has size 0; a NULL source
is a source, last in order; NULL ids are allowed; repeated rows are rows of
their own; with no words at all every target is 0; an empty table gives an
empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.ordered import positions, running
from tidemark.functions.session import materialize
from tidemark.llm.columns import WORD, join_null_safe, whole_text

#: target rows are broadcast up to so many sources, joined by shuffle beyond
BROADCAST_SOURCES = 100_000


def _size() -> Column:
    return F.regexp_count(whole_text("text"), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", _size().alias("size"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Per source: ``source_size`` and ``target`` words. ``weights`` repeat along the sources in code point order."""
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0] * share
    turn = F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int")
    weighted = positions(per, [], [F.col("source").asc_nulls_last()]).select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    )
    filled = running(
        weighted, [], [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()],
        {"caps": ("sum", F.col("cap")), "done": ("sum", F.col("weight"))},
    )
    all_weight = weighted.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    # the level if all earlier sources are clamped and this one is the first that is not
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))) / (F.lit(all_weight) - (F.col("done") - F.col("weight")))
    level = filled.select(level.alias("level"), "cap", "weight").where("level * weight <= cap").agg(F.max("level")).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.col("weight") * F.lit(level))
    return weighted.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Every document with ``copies`` and the words it gives to the mix (``taken``)."""
    sizes = materialize(sized(docs))
    goal = materialize(targets(sizes, weights, share, max_epochs))
    per_source = goal.select(F.col("source").alias("_source"), "source_size", "target")
    if goal.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    joined = join_null_safe(sizes, per_source, {"source": "_source"})
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    walked = running(
        joined.withColumn("draw", draw), ["source"], [F.col("draw"), F.col("doc_id"), F.col("size")], {"upto": ("sum", F.col("size"))},
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    # the document that crosses the target is taken if more than half of it lies before
    more = (F.col("upto") - F.col("size")).cast("double") + F.col("size") / F.lit(2.0) < rest
    return (
        walked.withColumn("whole", whole).withColumn("copies", F.col("whole") + more.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Repeated ids share their copies out as their rows come; all columns stay.
    """
    plan = materialize(mix(docs, **options))
    per_id = plan.groupBy("doc_id").agg(F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows"))
    once = per_id.where("_mix_rows = 1 and _mix_copies > 0").select(F.col("doc_id").alias("_mix_id"), "_mix_copies")
    out = _repeated(join_null_safe(docs, once, {"doc_id": "_mix_id"}))
    several = materialize(per_id.where("_mix_rows > 1").select(F.col("doc_id").alias("_mix_id")))
    if several.limit(1).count():
        # rows that share an id, source and size have equal plans up to order
        each = plan.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies")).alias("_mix_each"))
        each = each.select(F.col("doc_id").alias("_mix_i"), F.col("source").alias("_mix_s"), F.col("size").alias("_mix_z"), "_mix_each")
        held = join_null_safe(docs.withColumn("_mix_size", _size()), several, {"doc_id": "_mix_id"})
        turn = F.row_number().over(Window.partitionBy("doc_id", "source", "_mix_size").orderBy("text"))
        matched = join_null_safe(held.withColumn("_mix_turn", turn), each, {"doc_id": "_mix_i", "source": "_mix_s", "_mix_size": "_mix_z"})
        matched = matched.withColumn("_mix_copies", F.element_at("_mix_each", F.col("_mix_turn"))).where("_mix_copies > 0")
        out = out.unionByName(_repeated(matched.drop("_mix_size", "_mix_turn", "_mix_each")))
    return out


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).drop("_mix_copy", "_mix_copies")
