"""What of an archive may be unpacked: a judgement on its members as rows, before a byte is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds of one archive: bytes and number of its files, bytes of one, and how many times larger it may become."""

    total: int = 150 << 20
    files: int = 10_000
    each: int = 1 << 20
    ratio: float = 10.0
    #: Below so many bytes no ratio is looked at.
    small: int = 1 << 20


def _depth(path: Column) -> Column:
    """The least depth that a path of slashes comes to, counted from its start: below 0 it leaves."""
    steps = F.transform(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), lambda p: F.when(p == "..", -1).otherwise(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("least"))
    return F.aggregate(steps, start, lambda a, s: F.struct((a["at"] + s).alias("at"), F.least(a["least"], a["at"] + s).alias("least")))["least"]


def judged(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """archive, member, path, verdict of every member.

    ``members``: archive, archive_bytes, member, kind (file, directory, link), link,
    size. Verdicts: ``ok``; ``skip`` for links that are absolute or leave, and for empty
    names; ``escapes`` for a path with two slashes in front, a drive or ".." in it (one slash in front goes);
    ``too_large`` for a file over its limit; ``conflict`` for a path that is both a file
    and a folder. Path ``null`` is skipped.
    """
    raw = F.replace(F.trim("member"), F.lit("\\"), F.lit("/"))
    absolute = lambda c: c.startswith("/") | c.rlike(r"^.:")
    outside = raw.startswith("//") | raw.rlike("^[A-Za-z]:") | F.array_contains(F.split(raw, "/"), "..")
    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", "."))
    clean = F.array_join(parts, "/")
    link = F.replace(F.trim("link"), F.lit("\\"), F.lit("/"))
    folder = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    leaves = absolute(link) | (_depth(F.concat(folder, F.lit("/"), link)) < 0)
    verdict = (
        F.when(F.coalesce(clean, F.lit("")) == "", "skip")
        .when(outside, "escapes")
        .when((F.col("kind") == "link") & F.coalesce(leaves, F.lit(True)), "skip")
        .when((F.col("kind") == "file") & (F.col("size") > limits.each), "too_large")
        .otherwise("ok")
    )
    rows = members.select("archive", "member", "kind", clean.alias("path"), verdict.alias("verdict"))
    kinds = rows.filter("verdict = 'ok'").groupBy(F.col("archive").alias("__a"), F.col("path").alias("__p")).agg(F.count_distinct("kind").alias("__k"))
    double = kinds.filter("__k > 1").select("__a", "__p", F.lit(True).alias("__double"))
    joined = rows.join(double, (F.col("archive") == F.col("__a")) & (F.col("path") == F.col("__p")), "left")
    return joined.select("archive", "member", F.nullif("path", F.lit("")).alias("path"), F.when(F.col("__double") & (F.col("verdict") == "ok"), "conflict").otherwise(F.col("verdict")).alias("verdict"))


def admitted(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """archive, files, bytes, refused: the first reason why an archive is refused as a whole, null if it may be unpacked."""
    told = judged(members, limits)
    bad = told.filter(F.col("verdict").isin("escapes", "too_large", "conflict")).groupBy(F.col("archive").alias("__b")).agg(F.min("verdict").alias("bad"))
    sizes = members.groupBy("archive").agg(F.max("archive_bytes").alias("packed"), F.count_if(F.col("kind") == "file").alias("files"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("bytes"))
    refused = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("files") > limits.files, "too_many_files")
        .when(F.col("bytes") > limits.total, "too_many_bytes")
        .when((F.col("packed") > 0) & (F.col("bytes") > limits.small) & (F.col("bytes") / F.col("packed") > limits.ratio), "expands_too_much")
    )
    return sizes.join(bad, F.col("archive") == F.col("__b"), "left").select("archive", "files", "bytes", refused.alias("refused"))


def single_root(told: DataFrame) -> DataFrame:
    """archive, root: the one folder under which all that may be unpacked stands; null if there is no such folder."""
    top, deep = F.split_part("path", F.lit("/"), F.lit(1)), F.contains("path", F.lit("/"))
    each = told.filter("verdict = 'ok'").groupBy("archive").agg(F.min(top).alias("a"), F.max(top).alias("b"), F.bool_or(deep).alias("deep"))
    return each.select("archive", F.when((F.col("a") == F.col("b")) & F.col("deep"), F.col("a")).alias("root"))
