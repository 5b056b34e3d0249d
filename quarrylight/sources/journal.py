"""A numbered log in a folder: an entry is made only if its number is free, so writers never lose one another's."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a whole file to a place that has none; false if another was there first.

    The text is written beside the place. On a local or mounted file system a hard link then takes the name, elsewhere a rename that
    does not replace: both fail if the name is taken, and readers never see half a file.
    """
    files, where = _path(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    out = files.create(_path(spark, beside)[1], False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.getUri().getScheme() == "file":
        plain = lambda p: _path(spark, p)[1].toUri().getPath()
        try:
            os.link(plain(beside), plain(path))
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(_path(spark, beside)[1], False)
    if not files.exists(where) and files.rename(_path(spark, beside)[1], where):
        return True
    files.delete(_path(spark, beside)[1], False)
    return False


def numbers(spark: SparkSession, base: str) -> list[int]:
    """The numbers of the entries there are, in order; a log is short, an entry a swap."""
    files, where = _path(spark, base)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def append(spark: SparkSession, base: str, entry: dict, expected: int | None = None) -> int:
    """Adds an entry under the next free number and gives that. ``expected``: the last number that the writer saw; any later entry is an error then."""
    while True:
        last = (numbers(spark, base) or [0])[-1]
        if expected is not None and last != expected:
            raise RuntimeError(f"entry {last} came after {expected}")
        if _create(spark, f"{base}/{last + 1:012}.json", json.dumps(entry | {"number": last + 1})):
            return last + 1


def entries(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """All entries as rows."""
    found = numbers(spark, base)
    return spark.read.schema(schema).json([f"{base}/{n:012}.json" for n in found]) if found else spark.createDataFrame([], schema)
