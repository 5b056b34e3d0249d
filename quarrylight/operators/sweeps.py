"""Sweeps over sorted rows in bounded blocks: first conflicts, ranks, and joins of points with intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.sources.shared import settled

#: Rows of one block of a sweep, about.
BLOCK = 1 << 19
#: Ranks of one block of an interval join.
RUN = 1024


def _blocks(rows: DataFrame) -> int:
    """How many parts rows are dealt to: more of them for more rows, so that no task's share grows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / BLOCK))


def blocked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` sorted over partitions by group and order, with ``__block``: blocks follow the order, whatever the size of a group."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    return settled(rows.repartitionByRange(_blocks(rows), *keys).withColumn("__block", F.spark_partition_id()), "blocked")


def _so_far(rows: DataFrame, group: list[str], order: list[str], fold, value: Column, name: str) -> DataFrame:
    """Adds ``fold`` (sum or max) of ``value`` over the rows before each, by block and then over the few blocks of a group."""
    # Blocks are dealt to as many tasks as there are, in the way that windows and joins over them ask for.
    valued = rows.withColumn("__value", value).repartition(_blocks(rows), *group, "__block")
    per = rows.withColumn("__value", value).groupBy(*group, "__block").agg(fold("__value").alias("__sum"))
    before = W.partitionBy(*group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    names = [f"__g{i}" for i in range(len(group))]
    carry = per.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("__block").alias("__of"), fold("__sum").over(before).alias("__carry"))
    inside = W.partitionBy(*group, "__block").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    met = F.col("__block") == F.col("__of")
    for g, n in zip(group, names, strict=True):
        met = met & F.col(g).eqNullSafe(F.col(n))
    both = valued.withColumn("__here", fold("__value").over(inside)).join(carry, met)
    total = F.coalesce("__here", F.lit(0)) + F.coalesce("__carry", F.lit(0)) if fold is F.sum else F.greatest("__here", "__carry")
    return both.withColumn(name, total).select(*rows.columns, name)


def first_conflicts(spans: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """group, key, conflict: each span that overlaps one before it (by start, end and key), with that of those that reaches farthest.

    So a group of n spans gives n rows at most, and one is free of overlaps if it gives none. Groups are swept in
    blocks of sorted rows, so a hot one is no task's alone. Spans include both
    ends; those with a null start or end overlap nothing.
    """
    rows = blocked(spans.select(group, key, start, end).filter(F.col(start).isNotNull() & F.col(end).isNotNull()), [group], [start, end, key])
    swept = _so_far(rows, [group], [start, end, key], F.max, F.struct(F.col(end).alias("end"), F.col(key).alias("key")), "__reach")
    return swept.filter(F.col("__reach.end") >= F.col(start)).select(group, key, F.col("__reach.key").alias("conflict"))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's rank from 0 within its group, without a task that holds a group."""
    return _so_far(blocked(rows, group, order), group, order, F.sum, F.lit(1).cast("long"), name)


def points_in_intervals(points: DataFrame, intervals: DataFrame, group: str, point: str, key: str, low: str, high: str, closed: str | None = None) -> DataFrame:
    """group, point, key: every point with the intervals of its group that hold it, from ``low`` up to ``high``, which counts where ``closed`` says so.

    ``points``: group, point (any type that sorts); ``intervals``: key, group, low, high; a null low or high is no bound. Points and ends
    are sorted together once, so an interval becomes a run of its group's ranks, and runs meet the points of
    the blocks of ranks that they touch. The work grows with what is put out, not with points times intervals. Equal points are one; nulls lie in nothing.
    """
    last = F.coalesce(F.col(closed), F.lit(False)) if closed else F.lit(False)
    held = settled(intervals.select(F.col(group).alias("__group"), F.col(key).alias("__key"), F.col(low).alias("lo"), F.col(high).alias("hi"), last.alias("closed")).withColumn("__i", F.monotonically_increasing_id()), "intervals")
    nobody = F.lit(None).cast("long").alias("of")
    every = points.select(F.col(group).alias("g"), F.col(point).alias("at")).distinct().filter(F.col("at").isNotNull()).select("g", "at", F.lit(0).alias("side"), nobody, F.lit(False).alias("is_high"))
    for value, side, is_high in (("lo", F.lit(-1), False), ("hi", F.when(F.col("closed"), 1).otherwise(-1), True)):
        every = every.unionByName(held.filter(F.col(value).isNotNull()).select(F.col("__group").alias("g"), F.col(value).alias("at"), side.alias("side"), F.col("__i").alias("of"), F.lit(is_high).alias("is_high")))
    order = ["at", "side", "of", "is_high"]
    counted = F.when(F.col("side") == 0, 1).otherwise(0).cast("long")
    placed = settled(_so_far(blocked(every, ["g"], order), ["g"], order, F.sum, counted, "rank"), "placed")
    found = placed.filter("side = 0").select("g", "at", "rank", F.floor(F.col("rank") / RUN).alias("run"))
    ends = placed.filter("side <> 0").groupBy("of").agg(F.max(F.when(~F.col("is_high"), F.col("rank"))).alias("a"), F.max(F.when(F.col("is_high"), F.col("rank"))).alias("b"))
    sizes = found.groupBy(F.col("g").alias("__sized")).agg(F.count(F.lit(1)).alias("n"))
    runs = held.join(ends, F.col("__i") == F.col("of"), "left").join(sizes, F.col("__group").eqNullSafe(F.col("__sized")))
    runs = runs.select("__key", "__group", F.when(F.col("lo").isNull(), 0).otherwise(F.col("a")).alias("a"), F.when(F.col("hi").isNull(), F.col("n")).otherwise(F.col("b")).alias("b")).filter("a < b")
    dealt = runs.withColumn("__run", F.explode(F.sequence(F.floor(F.col("a") / RUN), F.floor((F.col("b") - 1) / RUN))))
    hit = F.col("g").eqNullSafe(F.col("__group")) & (F.col("run") == F.col("__run")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))
    return found.join(dealt, hit).select(F.col("g").alias(group), F.col("at").alias(point), F.col("__key").alias(key))
