"""Filters, latest rows, first occurrences, reconciliation, overlaps, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def paged(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """A page, with ``total``: how many rows there are in all. Those are counted apart, so that no window holds them."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, number, size).join(F.broadcast(total))  # one row


def listed(df: DataFrame, wanted: dict[str, object], order: list[Column | str], number: int, size: int) -> DataFrame:
    """A page of the rows that have all wanted values, with ``total``; a value None asks for nothing."""
    kept = df
    for column, value in wanted.items():
        if value is not None:
            kept = kept.filter(F.col(column) == F.lit(value))
    return paged(kept, order, number, size)


def flagged(df: DataFrame, column: str, wanted: bool | None) -> DataFrame:
    """Rows whose flag is as wanted; all of them if nothing is."""
    return df if wanted is None else df.filter(F.col(column) == wanted)


def running(runs: DataFrame, status: str, started: str, now: Column, seconds: int = 120) -> DataFrame:
    """Runs that are under way and began less than ``seconds`` ago: another must wait for them."""
    return runs.filter((F.col(status) == "running") & (F.unix_timestamp(now) - F.unix_timestamp(started) < seconds))


def missing(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Different keys of ``wanted`` that ``known`` has not."""
    return wanted.select(key).distinct().join(known.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def preferred(rows: DataFrame, by: list[str], order: str, direct: str, columns: list[str]) -> DataFrame:
    """One row per group: the first that is marked direct, else the first of all."""
    mark = F.coalesce(F.col(direct), F.lit(False))
    return first_seen(rows, by, F.struct((~mark).alias("later"), order), columns)


def matches(column: str, wanted: str) -> Column:
    """Case-insensitive LIKE: % and _ in ``wanted`` are wildcards."""
    return F.lower(column).like(f"%{wanted.lower()}%")


def latest(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per group, the one with the greatest ``order``; combined before the shuffle."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("__best"))
    return best.select(*by, "__best.*")


def first_seen(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    best = df.groupBy(*by).agg(F.min_by(F.struct(*columns), order).alias("__best"))
    return best.select(*by, "__best.*")


def repeats(df: DataFrame, by: list[str], line: str) -> DataFrame:
    """Second and later occurrences within ``by``, with the line of the first."""
    own = W.partitionBy(*by).orderBy(line)
    seen = df.withColumn("occurrence", F.row_number().over(own)).withColumn("first_line", F.first(line).over(own))
    return seen.filter("occurrence > 1")


def histogram(df: DataFrame, value: Column, domain: list[str]) -> DataFrame:
    """Counts for every value of the domain, zeros included."""
    spark = df.sparkSession
    counts = df.groupBy(value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    every = spark.createDataFrame([(x,) for x in domain], "value string")
    return every.join(counts, F.col("value") == F.col("__v"), "left").select("value", F.coalesce("__n", F.lit(0)).alias("n"))


def reconcile(declared: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Declared rows with what they resolve to, and resolved rows that nothing declares.

    Both sides: key and version. A declared row counts as matched if its resolved
    version is not empty; resolved rows of unmatched keys stand for themselves.
    """
    locked = resolved.select(F.col(key).alias("__k"), F.col("version").alias("resolved"))
    direct = declared.join(locked, F.col(key) == F.col("__k"), "left").select(key, F.col("version").alias("declared"), F.nullif("resolved", F.lit("")).alias("resolved"), F.lit(True).alias("is_direct"))
    only = resolved.join(declared.select(F.col(key).alias("__k")), (F.col(key) == F.col("__k")) & (F.coalesce("version", F.lit("")) != ""), "left_anti")
    return direct.unionByName(only.select(key, F.lit(None).cast("string").alias("declared"), F.col("version").alias("resolved"), F.lit(False).alias("is_direct")))


def overlaps(spans: DataFrame, group: str, key: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of spans of one group that overlap, smaller key first; each pair once.

    Spans are dealt to the buckets of ``bucket`` units that they touch, so a group
    with many spans is spread; a pair is kept only in the first bucket both touch.
    """
    at = F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)))
    dealt = spans.select(group, key, start, end, at.alias("cell"))
    a = dealt.select(group, "cell", F.col(key).alias("a_id"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    b = dealt.select(F.col(group).alias("g2"), F.col("cell").alias("cell2"), F.col(key).alias("b_id"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    hit = (F.col(group) == F.col("g2")) & (F.col("cell") == F.col("cell2")) & (F.col("a_id") < F.col("b_id"))
    hit = hit & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    once = F.col("cell") == F.floor(F.greatest("a_start", "b_start") / bucket)
    return a.join(b, hit).filter(once).select(group, "a_id", "b_id")
