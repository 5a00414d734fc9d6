"""Mixing sources to target weights by a time-varying curriculum.

Targets. Every source has a weight; the weights share ``share`` times all words. A source's target
stops at ``limit`` times its size and the excess is shared again by weight until none is above:
with sources in order of limit per weight, this is one pass of running sums over the source table
(one row per source).

Documents. A source's words form a stream of epochs: its documents in the order of a hash, over
and over. Full epochs fit wholly; the rest of the target is filled in FILLS rounds, each of which
takes the documents that still fit, in hash order, while their running sum stays below what is left.
So documents are taken whole, none is taken more often than ``limit`` rounded up, and what is
missing from a target is less than the document that came next.

Positions. A source's weight may change over training time: ``curriculum`` gives lines through
(time, weight) knots. Their integral is the source's cumulative demand, and inverting it at a
document's place in the stream gives the time at which the document is due. Sorting all copies by
that position yields the training order.

Running sums are taken in two levels, hash buckets of a source first and then documents within a
bucket, so a source that holds a third of all rows is spread over BUCKETS windows. Everything is
expressed in DataFrame functions; only ids, sizes and hashes are shuffled, not texts.

Defined results: a null text has size 0; null sources form one source, the last; a source without
words has target 0 and is not taken; rows repeated with their id are documents of their own; rows
with null ids are mixed like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicgauge.llm.common import fresh
from topicgauge.sources.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
#: Knots (time, weight) of the sources, repeating in their order: rising, steady, falling.
CURRICULUM = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
FILLS = 3
#: Buckets per source, as hexadecimal digits of the hash: 16^3.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def repeating(values: Sequence, number: Column) -> Column:
    """The value of the ``number``-th source, counted from 1."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """``source, source_no, source_size, target`` of a table ``source, size``."""
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "source_no")
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name))
        .withColumn("weight", repeating([float(w) for w in weights], F.col("source_no")))
        .withColumn("cap", F.col("source_size") * F.lit(float(limit)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the level of the first source, in order of ratio, that stays below its cap holds for all after it
    levels = sources.withColumn("level", level)
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source_no", "level"))
    levels = levels.withColumn("water", F.min(free).over(everything)["level"])
    return levels.select(
        "source", "source_no", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target")
    )


def running_start(rows: DataFrame, value: str, into: str) -> DataFrame:
    """The sum of ``value`` over a source's rows before this one in hash order."""
    buckets = rows.groupBy("source_no", "bucket").agg(F.sum(value).alias("_held"))
    ahead = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("source_no", "bucket", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_ahead"))
    within = W.partitionBy("source_no", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(offsets, ["source_no", "bucket"])
        .withColumn(into, F.col("_ahead") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_ahead")
    )


def due(x: Column, knots: Column) -> Column:
    """The time at which the share ``x`` of a source's demand is reached: the inverse of the schedule's integral."""
    spans = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            knots[i - 1]["t"].alias("t"), (knots[i]["t"] - knots[i - 1]["t"]).alias("h"), knots[i - 1]["w"].alias("w"),
            (knots[i]["w"] - knots[i - 1]["w"]).alias("rise"),
        ),
    )
    area = lambda s: (s["w"] + s["rise"] / 2) * s["h"]
    total = F.aggregate(spans, F.lit(0.0), lambda sum_, s: sum_ + area(s))
    start = F.struct(F.lit(None).cast("double").alias("at"), (x * total).alias("left"))

    def step(state: Column, s: Column) -> Column:
        left = state["left"]
        root = s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + F.lit(2.0) * s["rise"] * left / s["h"], F.lit(0.0)))
        inside = s["t"] + F.coalesce(F.lit(2.0) * left / F.when(root > 0, root), F.lit(0.0))
        ends = state["at"].isNull() & (left <= area(s))
        return F.struct(F.when(ends, inside).otherwise(state["at"]).alias("at"), (left - area(s)).alias("left"))

    return F.coalesce(F.aggregate(spans, start, step, lambda state: state["at"]), F.lit(1.0))


def schedule(curriculum, source_no: Column) -> Column:
    lines = [F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in knots]) for knots in curriculum]
    return F.element_at(F.array(*lines), (F.pmod(source_no - 1, F.lit(len(lines))) + 1).cast("int"))


def mixture(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, curriculum=CURRICULUM
) -> DataFrame:
    """One row per document: size, its source's size and target, copies and words taken, due positions of the copies."""
    hash_ = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    slim = materialize(docs.select("doc_id", F.col("source").cast("string"), size.alias("size"), hash_.alias("hash")))
    sources = materialize(source_targets(slim.select("source", "size"), weights, share, limit))
    epochs = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    plan = (
        sources.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "_source")
    )
    rows = (
        slim.join(plan.select("_source", "source_no"), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source_no", "size", "hash", F.substring("hash", 1, BUCKET_DIGITS).alias("bucket"))
    )
    rows = materialize(running_start(rows, "size", "epoch_start").withColumn("rest_start", F.lit(None).cast("long")))
    plan = plan.select("source_no", "source_size", "target", "epochs", "left").withColumn("filled", F.lit(0).cast("long"))
    for _ in range(FILLS):
        open_ = F.col("rest_start").isNull() & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        rows = rows.join(plan.select("source_no", "left", "filled"), "source_no").withColumn("_open", F.when(open_, F.col("size")).otherwise(0))
        rows = running_start(rows, "_open", "_start")
        fits = open_ & (F.col("_start") + F.col("size") <= F.col("left"))
        rows = materialize(
            rows.withColumn("rest_start", F.when(fits, F.col("filled") + F.col("_start")).otherwise(F.col("rest_start")))
            .drop("_open", "_start", "left", "filled")
        )
        taken = rows.groupBy("source_no").agg(F.sum(F.when(F.col("rest_start").isNotNull(), F.col("size")).otherwise(0)).alias("_taken"))
        plan = materialize(
            plan.join(taken, "source_no").withColumn("left", F.col("left") + F.col("filled") - F.col("_taken"))
            .withColumn("filled", F.col("_taken")).drop("_taken")
        )
    full = rows.join(plan.drop("left"), "source_no")
    stream = F.col("epochs") * F.col("source_size") + F.col("filled")
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(F.col("rest_start").isNotNull(), 1).otherwise(0)).otherwise(0)
    starts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("copies") - 1),
        lambda e: F.when(e < F.col("epochs"), e * F.col("source_size") + F.col("epoch_start"))
        .otherwise(F.col("epochs") * F.col("source_size") + F.col("rest_start")),
    )
    knots = schedule(curriculum, F.col("source_no"))
    positions = F.transform(starts, lambda s: due((s + F.col("size") / F.lit(2.0)) / stream, knots))
    return full.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source_no", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, positions).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with all their columns, in training order."""
    doc, row, mixed_row, position = fresh(docs, "doc", "row", "mixed_row", "position")
    mix = mixture(docs, **options).withColumn(mixed_row, F.row_number().over(W.partitionBy("doc_id").orderBy("source_no", "size")))
    mix = mix.filter("copies > 0").select(F.col("doc_id").alias(doc), mixed_row, F.explode("positions").alias(position))
    # rows that repeat an id are told apart by source and size
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    within = W.partitionBy("doc_id").orderBy(F.col("source").cast("string").asc_nulls_last(), size)
    keyed = docs.select("*", F.row_number().over(within).alias(row))
    joined = keyed.join(mix, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(mixed_row)))
    return joined.orderBy(position, "doc_id").select(*docs.columns)
