"""Verified copies of tables: checksums that no order of rows changes, in a tree, and what a bad copy lost."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.sources.shared import settled

#: Rows fall to so many leaves by a hash of their key, and so many nodes hang below one.
LEAVES, FAN = 256, 16


def _plain(field: T.StructField) -> Column:
    """A column as the hash can take it: maps become sorted entries."""
    c = F.col(f"`{field.name}`")
    return F.array_sort(F.map_entries(c)) if isinstance(field.dataType, T.MapType) else c.cast("string") if isinstance(field.dataType, T.VariantType) else c


def row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of all of a row's columns by name; where the nulls stand counts, the order of the columns does not."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    nulls = F.concat(*[F.when(F.col(f"`{f.name}`").isNull(), "0").otherwise("1") for f in fields]) if fields else F.lit("")
    return F.xxhash64(F.lit(seed), nulls, *map(_plain, fields))


def leaf_of(key: list[str], leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]), leaves).cast("int")


def leaf_sums(df: DataFrame, key: list[str], leaves: int = LEAVES) -> DataFrame:
    """leaf, rows, digest for every leaf that has rows: the digest is of the sums of two hashes of each row.

    Sums do not depend on the order or the partitions of rows, they are combined before
    the shuffle, and unlike exclusive ors they tell a row that occurs twice. Null keys are keys.
    """
    add = lambda seed: F.sum(row_hash(df, seed).cast("decimal(38,0)")).cast("string")
    sums = df.groupBy(leaf_of(key, leaves).alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), add(1).alias("a"), add(2).alias("b"))
    return sums.select("leaf", "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "a", "b"), 256).alias("digest"))


def tree(sums: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """level (0 are the leaves), node, rows, digest up to one root: a node's digest is that of its nodes' numbers and digests."""
    level = sums.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), "rows", "digest")
    every, n, width = level, 0, leaves
    while n == 0 or width > 1:
        n, width = n + 1, -(-width // FAN)
        below = F.array_sort(F.collect_list(F.struct("node", "digest")))
        text = F.array_join(F.transform(below, lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["digest"])), ",")
        level = level.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(text, 256).alias("digest")).select(F.lit(n).alias("level"), "node", "rows", "digest")
        every = every.unionByName(level)
    return every


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the place and moves: a manifest is there whole or not at all."""
    files, where = _files(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    out = files.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files.delete(where, False)
    if not files.rename(beside, where):
        raise OSError(f"{path} could not be written")


def copy(df: DataFrame, path: str, key: list[str], leaves: int = LEAVES) -> str:
    """Writes a table to ``path`` with a manifest of its checksums, and gives the root's digest.

    What was written is read again and must have the sums of ``df``; only then the manifest
    is put there, which names its folder. A copy that fails leaves the last good one in place. Only the leaves' sums come to the driver.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    sums = settled(leaf_sums(df, key, leaves), "sums")
    df.write.parquet(f"{path}/{folder}")
    wrong = differing(sums, leaf_sums(spark.read.schema(df.schema).parquet(f"{path}/{folder}"), key, leaves))
    if bad := [r["leaf"] for r in wrong.select("leaf").collect()]:
        raise OSError(f"the copy differs in leaves {bad[:10]}")
    root = tree(sums, leaves).orderBy(F.desc("level")).first()
    digest = root["digest"] if root else ""
    told = {"folder": folder, "key": key, "leaves": leaves, "root": digest, "schema": df.schema.json(), "sums": [list(r) for r in sums.orderBy("leaf").collect()]}
    _put(spark, f"{path}/manifest.json", json.dumps(told))
    return digest


def manifest(spark: SparkSession, path: str) -> dict:
    (row,) = spark.read.option("wholetext", True).text(f"{path}/manifest.json").collect()
    return json.loads(row["value"])


def copied(spark: SparkSession, path: str) -> DataFrame:
    told = manifest(spark, path)
    return spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).parquet(f"{path}/{told['folder']}")


def differing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """leaf, expected_rows, found_rows, verdict of leaves that are not the same: lost, added or changed rows."""
    other = found.select(F.col("leaf").alias("__leaf"), F.col("rows").alias("__rows"), F.col("digest").alias("__digest"))
    both = expected.join(other, F.col("leaf") == F.col("__leaf"), "full")
    had, has = F.coalesce("rows", F.lit(0)), F.coalesce("__rows", F.lit(0))
    verdict = F.when(had > has, "lost").when(had < has, "added").otherwise("changed")
    return both.filter(~F.col("digest").eqNullSafe(F.col("__digest"))).select(F.coalesce("leaf", "__leaf").alias("leaf"), had.alias("expected_rows"), has.alias("found_rows"), verdict.alias("verdict"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of a copy that are no longer as its manifest says; none if it is whole."""
    told = manifest(spark, path)
    expected = spark.createDataFrame(told["sums"], "leaf int, rows long, digest string")
    return differing(expected, leaf_sums(copied(spark, path), told["key"], told["leaves"]))


def restore(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A copy that is whole, written to ``target``, which must be new, and checked there again."""
    if bad := verify(spark, path).limit(1).collect():
        raise OSError(f"the copy is damaged: {bad[0]['verdict']} rows in leaf {bad[0]['leaf']}")
    told = manifest(spark, path)
    copied(spark, path).write.mode("error").parquet(target)
    back = spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).parquet(target)
    if differing(spark.createDataFrame(told["sums"], "leaf int, rows long, digest string"), leaf_sums(back, told["key"], told["leaves"])).limit(1).collect():
        raise OSError("what was restored differs from the copy")
    return back


def differences(before: DataFrame, after: DataFrame, key: list[str], leaves: int = LEAVES) -> DataFrame:
    """The keys, and lost, added, changed or repeated as ``verdict``, in which two tables differ.

    Leaves with the same sums are left out before anything is joined, so of two nearly equal tables nearly
    no row is shuffled; the list of leaves is bounded. Null keys meet each other.
    """
    at = leaf_of(key, leaves)
    bad = differing(leaf_sums(before, key, leaves), leaf_sums(after, key, leaves)).select(F.col("leaf").alias("__bad"))
    bad = F.broadcast(settled(bad, "leaves"))  # at most ``leaves`` numbers

    def told(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*[F.col(k).alias(f"{name}{i}") for i, k in enumerate(key)], row_hash(df, 1).cast("decimal(38,0)").alias("h"), at.alias("__at"))
        rows = rows.join(bad, F.col("__at") == F.col("__bad"))
        return rows.groupBy(*[f"{name}{i}" for i in range(len(key))]).agg(F.count(F.lit(1)).alias(f"{name}n"), F.sum("h").alias(f"{name}s"), F.min("h").alias(f"{name}lo"), F.max("h").alias(f"{name}hi"))

    a, b = told(before, "__a"), told(after, "__b")
    same = F.lit(True)
    for i in range(len(key)):
        same = same & F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))
    both = a.join(b, same, "full")
    alike = (F.col("__alo") == F.col("__ahi")) & (F.col("__blo") == F.col("__bhi")) & (F.col("__alo") == F.col("__blo"))
    verdict = F.when(F.col("__bn").isNull(), "lost").when(F.col("__an").isNull(), "added").when(alike & (F.col("__an") < F.col("__bn")), "repeated").when(alike & (F.col("__an") > F.col("__bn")), "lost").otherwise("changed")
    other = (F.col("__as") != F.col("__bs")) | (F.col("__an") != F.col("__bn")) | F.col("__an").isNull() | F.col("__bn").isNull()
    return both.filter(other).select(*[F.coalesce(f"__a{i}", f"__b{i}").alias(k) for i, k in enumerate(key)], verdict.alias("verdict"))
