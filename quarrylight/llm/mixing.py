"""Mixing sources to target weights by whole and hash-seeded fractional copies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.llm.common import WORD, settled

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str = "text") -> Column:
    """Maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def chance(key: str, seed: int) -> Column:
    """A number in [0, 1) that the key and the seed alone decide (32 bits of MD5)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(src, source_size, target) from (source, size), one row per source.

    Sources in code-point order, null last, take the weights in turn. The total of
    all sizes is shared by weight; a target stops at ``most`` times its source's
    size and the excess is shared again by weight among the rest. That ends where
    one level times the weight is every open source's target: sources are sorted by
    cap over weight, and the first is found whose cap exceeds the level left by the
    caps before it. The table holds one row per source, never a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    ahead, rest, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    level = left / F.sum("w").over(rest)
    per = per.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
    per = per.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("final")))
    return per.select(F.col("source").alias("src"), "source_size", target.alias("target"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 9, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and ``copies``: how often the mix takes it.

    The rate of a source is its target over its size. A document is taken
    floor(rate) times, and once more with a chance of the fraction, which the key
    and the seed decide, so reruns and retried tasks agree. Sizes are summed per
    source before anything is shuffled; the source table joins back by size, so
    Spark broadcasts it when it is small and splits a hot source when it is not.

    Null texts have size 0; a null source is one source of its own, the last. A
    source whose rows are all empty has target 0 and is not taken. Repeated rows
    share their key's decision. Of a text, however long, only the number of its words
    goes on. An empty table gives no row. Columns that are not in ``keep`` are not looked at.
    """
    keep = [key] if keep is None else keep
    found = _taken(docs, key, text, source, weights, most, seed, keep)
    return found.select(*keep, *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "copies")])


def _taken(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], most: float, seed: int, keep: list[str]) -> DataFrame:
    """``keep`` and what ``copies`` adds, under names that no column of ``docs`` has."""
    sized = docs.select(*keep, F.col(source).alias("__source"), word_count(text).alias("__size"), chance(key, seed).alias("__chance"))
    targets = source_targets(docs.select(F.col(source).alias("source"), word_count(text).alias("size")), weights, most)
    targets = settled(targets, "targets")  # its size is then known before the join is planned
    targets = targets.select(*[F.col(c).alias(f"__{c}") for c in ("src", "source_size", "target")])
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col("__source").eqNullSafe(F.col("__src")))
    whole = F.floor(rate)
    taken = (whole + F.when(F.col("__chance") < rate - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn("__copies", taken)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 9) -> DataFrame:
    """The mix itself: each row of ``docs``, whole and with all its columns, as often as it is taken."""
    # Whole rows go as one struct, so that no column of theirs meets a name of the mix.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("__k"), F.col(text).alias("__t"), F.col(source).alias("__s"))
    taken = _taken(rows, "__k", "__t", "__s", weights, most, seed, ["row"]).filter("__copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")
