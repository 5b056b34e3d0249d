"""A search index that is kept: postings sorted by term in blocks with their best score, and searches that skip blocks."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.retrieval import B, K1, LEAST_SCORE
from quarrylight.operators.sweeps import ranked
from quarrylight.sources import journal

#: Rows of a stratum: rows of like length stand together, so that a block's best score says something.
STRATUM = 256
#: Strata that are read first, to know what the best hits have at least.
PROBES = 8


@dataclass
class Found:
    """``hits``: key, raw_score of the best; how many blocks of the query's terms were read, and how many there are."""

    hits: DataFrame
    read: int
    blocks: int


def _weight(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _counted(rows: DataFrame) -> DataFrame:
    """key, len and terms, how often each is among ``found``, of (key, found) rows: a row is counted where it is read."""
    term = pa.struct([("term", pa.string()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, STRATUM) for b in batches for at in range(0, b.num_rows, STRATUM)):
            lists = batch.column(1).to_pylist()
            terms = pa.array([[{"term": t, "tf": n} for t, n in Counter(x).items()] for x in lists], pa.list_(term))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lists], pa.int64()), terms], names=["key", "len", "terms"])

    each = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.select("key", "found").mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("len", T.LongType()), T.StructField("terms", T.ArrayType(each))]))


def build(docs: DataFrame, base: str, key: str, tokens: Column) -> int:
    """Writes an index of ``docs`` under ``base`` and makes it the current one, by its number.

    Rows are ranked by length and cut into strata of ``STRATUM``; a block is what one term has in one stratum: its rows, and
    the best that any of them can add to a score. Blocks are sorted by term, so the files' statistics find a query's terms and no
    other is read. Texts are read once, terms are counted in their row, and what a term has in a row moves once, to its block. Null texts have no term.
    """
    spark = docs.sparkSession
    name = uuid.uuid4().hex
    rows = docs.select(F.col(key).alias("key"), F.coalesce(tokens, F.array().cast("array<string>")).alias("found"))
    _counted(rows).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{base}/{name}/read")
    read = spark.read.parquet(f"{base}/{name}/read")
    told = read.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average")).first()
    average = float(told["average"] or 0) or 1.0
    placed = ranked(read.select("row", "len", "key"), [], ["len", "key", "row"]).select(F.col("row").alias("of"), F.floor(F.col("rank") / STRATUM).alias("stratum"))
    met = read.join(placed, F.col("row") == F.col("of")).select("key", "len", "stratum", F.explode("terms").alias("t")).select("key", "len", "stratum", "t.term", "t.tf")
    best = F.max(_weight(F.col("tf"), F.col("len"), average)).alias("best")
    # Dealt by range first, so that what is gathered is not moved again.
    dealt = met.repartitionByRange("term", "stratum")
    blocks = dealt.groupBy("term", "stratum").agg(F.count(F.lit(1)).alias("n"), best, F.collect_list(F.struct("key", "tf", "len")).alias("rows"))  # STRATUM at most
    blocks.sortWithinPartitions("term", "stratum").write.parquet(f"{base}/{name}/blocks")
    return journal.append(spark, f"{base}/log", {"name": name, "n": told["n"], "average": average})


def _current(spark: SparkSession, base: str) -> dict:
    (row,) = journal.entries(spark, f"{base}/log", "number long, name string, n long, average double").orderBy(F.desc("number")).limit(1).collect()
    return row.asDict()


def top(spark: SparkSession, base: str, query: list[str], limit: int) -> Found:
    """The ``limit`` best rows for a query, those that a search of all blocks would give; ties by key.

    A stratum's terms together bound its rows' scores. The strata of the highest bounds are read first; the score that
    ``limit`` of their rows reach is a threshold, and strata whose bound is below it are not read. Terms that the query repeats count as often.
    """
    told = _current(spark, base)
    blocks = spark.read.parquet(f"{base}/{told['name']}/blocks")
    weights = {t: query.count(t) for t in query}
    mine = blocks.filter(F.col("term").isin(*weights)) if weights else blocks.limit(0)
    heads = mine.select("term", "stratum", "n", "best")
    df = {r["term"]: r["df"] for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term of the query
    idf = {t: math.log(1 + (told["n"] - n + 0.5) / (n + 0.5)) * weights[t] for t, n in df.items()}
    share = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in idf.items()], F.lit(0.0))
    bounds = heads.groupBy("stratum").agg(F.sum(share * F.col("best")).alias("bound"), F.count(F.lit(1)).alias("blocks"))

    def scored(some: DataFrame) -> DataFrame:
        rows = mine.join(some.select(F.col("stratum").alias("__s")), F.col("stratum") == F.col("__s"), "left_semi").select("term", F.explode("rows").alias("r"))
        part = share * _weight(F.col("r.tf"), F.col("r.len"), told["average"])
        return rows.groupBy(F.col("r.key").alias("key")).agg(F.sum(part).alias("raw_score")).filter(F.col("raw_score") > LEAST_SCORE)

    best = lambda hits: hits.orderBy(F.desc("raw_score"), "key").limit(limit)
    first = best(scored(bounds.orderBy(F.desc("bound"), "stratum").limit(PROBES))).collect()  # ``limit`` rows
    least = first[-1]["raw_score"] if len(first) == limit else LEAST_SCORE
    # Sums in another order may differ in their last digits.
    needed = bounds.filter(F.col("bound") >= least * (1 - 1e-9))
    sums = bounds.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("bound") >= least * (1 - 1e-9), F.col("blocks"))), F.lit(0)).alias("read")).first()
    return Found(best(scored(needed)), sums["read"], sums["all"])
