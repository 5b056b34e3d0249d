"""What several operators share: shared-folder tables, corpus reading, word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.shared import settled  # noqa: F401

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step inside a task holds as arrays.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; a longer text is a slice alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # what a batch took goes back before the next one


def word_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-cased white-space words: the distinct ones, each occurrence's index, each row's offset.

    Null texts have no word. An empty string may be among the distinct words; it
    stands for the edge of a text that starts or ends with white space.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's run; 0 for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def blockwise_rank(df: DataFrame, groups: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """Adds ``name``: each row's rank from 0 within its group, gapless, without one task per group.

    Rows are ranked inside (group, block), and blocks get their offset from the
    small table of block counts. ``block`` must be a bounded function of the row.
    """
    from pyspark.sql import Window as W

    blocked = df.withColumn("__block", block)
    counts = blocked.groupBy(*groups, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    ranked = blocked.withColumn(
        "__rank", F.row_number().over(W.partitionBy(*groups, "__block").orderBy(*order)) - 1
    )
    match = F.col("__block") == F.col("__b")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = ranked.join(offsets, match, "inner").withColumn(name, F.col("__before") + F.col("__rank"))
    return out.select(*df.columns, name)
