"""Balanced contiguous shards from global prefix sums of byte sizes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.llm.common import settled

#: Key ranges whose totals are summed before the shards are cut: one for about so many rows, within these bounds.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 250_000, 64, 2000
#: Hash parts of each range of equal keys, so that one key's rows do not meet in one task.
PARTS = 8


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot for every row of ``docs``.

    Rows stand in the order of (key range, hash part if one key fills a range, key,
    text checksum). Each range's total is known first; a row's global prefix is
    its range's offset plus the running sum inside the range, and its shard is the
    equal share of all bytes in which its middle falls, so shards are contiguous
    and differ from the mean by less than a document. ``slot`` counts a shard's
    rows from 0.

    Size is UTF-8 bytes plus 1; null texts count as empty (checksum 0). Null keys
    come first. Repeated rows stay, each in a slot of its own. An empty table gives
    no row. A document larger than a share leaves a neighbouring shard short or
    empty; none is ever cut. Of a text, however long, only its length and checksum go
    on. Other columns are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"))
    sized = settled(sized, "sized")
    ranges = max(MIN_RANGES, min(MAX_RANGES, sized.count() // RANGE_ROWS))
    cuts = sized.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    edges = [F.lit(x).cast(sized.schema["k"].dataType) for x in sorted(set(cuts))]
    below = F.size(F.filter(F.array(*edges), lambda e: e < F.col("k"))) if edges else F.lit(0)
    # A key that fills a range is cut twice or more and stands last in its range; hash parts follow the other keys.
    full = sorted({x for x in cuts if cuts.count(x) > 1})
    hot = F.when(F.col("k").isin(full), 1 + F.pmod(F.xxhash64("crc", "size"), F.lit(PARTS))) if full else F.lit(None)
    ranged = sized.withColumn("r", (below * (PARTS + 1) + F.coalesce(hot, F.lit(0))).cast("long"))
    totals = ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    ahead = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("r").alias("r2"),
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("all_bytes"),
    )
    inside = W.partitionBy("r").orderBy("k", "crc", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    placed = summed.join(offsets, F.col("r") == F.col("r2"))
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = placed.withColumn("middle", middle).select(
        "k", "size", "crc", F.expr(f"least({shards - 1}, (middle * {shards}) div (2 * all_bytes))").cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row")
    )
    placed = settled(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first")).withColumnRenamed("shard", "s")
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("s"))  # at most one row a shard
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))
