"""Repository files as rows: which there are, what they are, and how long. Contents are read once, by Spark."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import files as fl
from quarrylight.functions.text import line_count
from quarrylight.sources.shared import settled

#: Bounds of a repository: files, bytes of all, and bytes of a file whose lines are counted.
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES = 10_000, 150 << 20, 1 << 20


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (from ``root``) and size of every file under a folder, hidden ones too; ignored folders are not entered.

    Spark's own readers pass over names that start with a dot or an underscore, and
    with them ``__init__.py``; so folders are listed by tasks, one level after
    another. Links to folders are not followed, nor links to files outside ``root``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        local = isinstance(files, fs.LocalFileSystem)
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                for info in files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                    is_folder = info.type == fs.FileType.Directory
                    if local and os.path.islink(info.path) and (is_folder or not os.path.realpath(info.path).startswith(os.path.realpath(base) + os.sep)):
                        continue
                    rows.append((f"{folder}/{info.base_name}" if folder else info.base_name, is_folder, None if is_folder else info.size))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["path", "is_folder", "size"])

    found, level = [], spark.createDataFrame([("",)], "folder string")
    while True:
        entries = settled(level.mapInArrow(scan, "path string, is_folder boolean, size long"), "listed")
        found.append(entries.filter("NOT is_folder").select("path", "size"))
        level = entries.filter(F.col("is_folder") & ~fl.file_name(F.col("path")).isin(*fl.IGNORED_DIRECTORIES)).select(F.col("path").alias("folder"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (from ``root``), content, size of every file under a folder; each is read by the task that holds its row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with source.open_input_stream(f"{base}/{path}") as file:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary()), pa.array([size], pa.int64())], names=["path", "content", "size"])

    return listed(spark, root).select("path", "size").mapInArrow(read, "path string, content binary, size long")


def discovered(found: DataFrame, most_file: int = MOST_FILE_BYTES) -> DataFrame:
    """path, file_name, extension, language, category, is_source, size, is_binary, is_secret, line_count, sha256 of (path, content, size) rows.

    Files in ignored folders are left out. Lines are counted in text files alone,
    that are neither secret nor over ``most_file`` bytes; else they are null. A null
    content is binary.
    """
    kept = found.filter(~fl.ignored(F.col("path")))
    known = fl.language(F.col("path"))
    binary = F.coalesce(fl.known_binary(F.col("path")) | fl.binary_content(F.col("content")), F.lit(True))
    rows = kept.select("path", fl.file_name(F.col("path")).alias("file_name"), fl.ending(F.col("path")).alias("extension"), known.alias("k"), "size", binary.alias("is_binary"), fl.secret(F.col("path")).alias("is_secret"), "content")
    counted = ~F.col("is_binary") & ~F.col("is_secret") & (F.col("size") <= most_file)
    lines = F.when(counted, line_count(F.decode("content", "ISO-8859-1")))
    return rows.select("path", "file_name", "extension", "k.language", "k.category", (F.col("k.is_source") & ~F.col("is_binary")).alias("is_source"), "size", "is_binary", "is_secret", lines.alias("line_count"), F.sha2("content", 256).alias("sha256"))


def refused(rows: DataFrame, by: Column, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """owner, files, bytes, refused: repositories (``by``) that are over a bound are named with it, null for the others."""
    why = F.when(F.col("files") > most_files, "too_many_files").when(F.col("bytes") > most_bytes, "too_many_bytes")
    return rows.groupBy(by.alias("owner")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).withColumn("refused", why)


def readable(rows: DataFrame, found: DataFrame, expected: DataFrame | None = None, most_file: int = MOST_FILE_BYTES) -> DataFrame:
    """path, text, truncated, drifted: text files as analysis reads them, UTF-8 with wrong bytes replaced.

    Files over ``most_file`` bytes have no text and say so; ``drifted`` tells whether the
    bytes are no longer those that ``expected`` (path, sha256) has.
    """
    text = rows.filter("NOT is_binary AND NOT is_secret").select("path", "sha256", (F.col("size") > most_file).alias("truncated"))
    joined = text.join(found.select(F.col("path").alias("__path"), "content"), F.col("path") == F.col("__path"))
    body = F.when(~F.col("truncated"), F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8"))
    if expected is None:
        return joined.select("path", body.alias("text"), "truncated", F.lit(False).alias("drifted"))
    known = expected.select(F.col("path").alias("__e"), F.col("sha256").alias("__sha"))
    return joined.join(known, F.col("path") == F.col("__e"), "left").select("path", body.alias("text"), "truncated", F.coalesce(F.col("sha256") != F.col("__sha"), F.lit(False)).alias("drifted"))
