"""Answers that hold nothing but the retrieved evidence and where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as tx

#: Places that an answer rests on, and those that it shows.
MOST, SHOWN = 8, 5
#: Least score of an answer, and least score of a sure one.
RELEVANT, SURE = 0.05, 0.3


def evidence(hits: DataFrame, chunks: DataFrame, key: str, path: Column, text: str, start: Column, end: Column, most: int = MOST) -> DataFrame:
    """rank, key, path, citation, excerpt, score of the best ``most`` hits (key, score, rank).

    The hits are ``most`` rows at most and are broadcast, so only the chunks that
    they name are read further.
    """
    best = hits.filter(F.col("rank") <= most).orderBy("rank").limit(most).select(F.col(key).alias("hit"), "score", "rank")
    found = chunks.join(F.broadcast(best), F.col(key) == F.col("hit"))
    cite = F.concat(path, F.lit(":L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    return found.select("rank", key, path.alias("path"), cite.alias("citation"), tx.excerpt(F.col(text)).alias("excerpt"), "score")


def preview(excerpt: Column, most: int = 90) -> Column:
    """The first line that is not blank, cut to ``most`` characters; N/A without one."""
    lines = F.filter(F.split(excerpt, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.substring(F.get(lines, 0), 1, most), F.lit("N/A"))


def cited(citations: Column, known: Column) -> Column:
    """Those citations, in order and with repeats, that the evidence has."""
    return F.filter(citations, lambda c: F.array_contains(known, c))


def answered(places: DataFrame, question: str) -> DataFrame:
    """One row: question, confidence, citations, answer. ``places`` comes from ``evidence``, so it is a few rows.

    Without a place, or with a best score under ``RELEVANT``, the answer says so and cites nothing.
    """
    listed = places.agg(F.array_sort(F.collect_list(F.struct("rank", "citation", "path", "excerpt", "score"))).alias("e"))
    e, shown = F.col("e"), F.slice("e", 1, SHOWN)
    best = F.coalesce(F.get(e, 0)["score"], F.lit(0.0))
    line = lambda x: F.concat(x["rank"].cast("string"), F.lit(". ["), x["citation"], F.lit("] "), preview(x["excerpt"]))
    files = F.size(F.array_distinct(F.transform(shown, lambda x: x["path"])))
    head = F.concat(F.size(e).cast("string"), F.lit(" places in "), files.cast("string"), F.lit(" files on: "), F.lit(question))
    enough = best >= RELEVANT
    return listed.select(
        F.lit(question).alias("question"),
        F.when(~enough, "INSUFFICIENT_EVIDENCE").when(best >= SURE, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.when(enough, F.transform(e, lambda x: x["citation"])).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.when(enough, F.concat_ws("\n", head, F.array_join(F.transform(shown, line), "\n"))).otherwise(F.concat(F.lit("No evidence on: "), F.lit(question))).alias("answer"),
    )
