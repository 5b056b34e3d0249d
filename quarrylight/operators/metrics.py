"""Inventory metrics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distribution(files: DataFrame, by: str, size: str, lines: str) -> DataFrame:
    """Per value: files, bytes, lines and the share of files in percent, to two decimals."""
    groups = totals_by(files, by, size, lines)
    whole = groups.agg(F.sum("files").alias("__all"))
    return groups.join(F.broadcast(whole)).select(by, "files", "bytes", "lines", F.round(F.col("files") * 100.0 / F.col("__all"), 2).alias("percentage"))  # one row


def ordered(groups: DataFrame, by: str) -> DataFrame:
    """Groups with most files first, then most bytes, then by name."""
    return groups.orderBy(F.desc("files"), F.desc("bytes"), by)


def totals_by(files: DataFrame, by: str, size: str, lines: str) -> DataFrame:
    """Per value (a language, a category): files, bytes and lines; unknown line counts are 0."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.sum(F.coalesce(F.col(lines), F.lit(0))).alias("lines"))


def totals(files: DataFrame, size: str, lines: str, is_source: str | None = None) -> DataFrame:
    """One row: files, those that are sources, bytes and lines."""
    sources = F.count_if(F.col(is_source)) if is_source else F.lit(None).cast("long")
    return files.agg(F.count(F.lit(1)).alias("files"), sources.alias("source_files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.coalesce(F.col(lines), F.lit(0))), F.lit(0)).alias("lines"))


def largest(files: DataFrame, key: str, size: str, limit: int = 10) -> DataFrame:
    return files.select(key, size).orderBy(F.desc(size), key).limit(limit)


def dependency_counts(dependencies: DataFrame) -> DataFrame:
    """Per ecosystem: how many dependencies are resolved or not, direct or transitive."""
    resolved, direct = F.coalesce(F.col("resolved"), F.lit("")) != "", F.coalesce(F.col("is_direct"), F.lit(False))
    return dependencies.groupBy("ecosystem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(resolved).alias("resolved"), F.count_if(~resolved).alias("unresolved"), F.count_if(direct).alias("direct"), F.count_if(~direct).alias("transitive")
    )


def requests(log: DataFrame) -> DataFrame:
    """One row on (method, status, duration): requests, errors of both kinds, mean duration and the share of errors in percent; negative durations count as 0."""
    n, of = F.count(F.lit(1)), lambda k: F.count_if(F.floor(F.col("status") / 100) == k)
    bad = of(4) + of(5)
    return log.agg(
        n.alias("requests"), of(4).alias("errors_4xx"), of(5).alias("errors_5xx"), F.round(F.coalesce(F.avg(F.greatest("duration", F.lit(0.0))), F.lit(0.0)), 2).alias("avg_duration"),
        F.when(n > 0, F.round(bad / n * 100.0, 2)).otherwise(0.0).alias("error_rate"),
    )


def request_counts(log: DataFrame) -> DataFrame:
    """How many requests of each method and class of status (2xx to 5xx, other) there are."""
    kind = F.floor(F.col("status") / 100)
    named = F.when(kind.between(2, 5), F.concat(kind.cast("string"), F.lit("xx"))).otherwise("other")
    return log.groupBy(F.upper("method").alias("method"), named.alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


def tasks(log: DataFrame, key: str, state: str, order: list[str], final: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """How many tasks stand in each state, from a log of (key, state, order): a final state sticks, whatever is logged after it."""
    at = F.struct(*order)
    ended = F.min_by(state, F.when(F.col(state).isin(*final), at))
    last = log.groupBy(key).agg(F.coalesce(ended, F.max_by(state, at)).alias("state"))
    return last.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
