"""Indexes that follow their files: what two snapshots differ in, and an index brought from one to the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import fingerprint
from quarrylight.operators.chunking import index_run
from quarrylight.sources.shared import settled


@dataclass
class Updated:
    """``chunks``: the index of the new snapshot; ``tombstones``: path and chunk_index that went; ``changes``: path and change of every file that is not the same."""

    chunks: DataFrame
    tombstones: DataFrame
    changes: DataFrame


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, changed, gone) of files whose hash is not the same in two snapshots (path, sha256)."""
    old = before.select(F.col("path").alias("__path"), F.col("sha256").alias("__sha"))
    both = after.select("path", "sha256").join(old, F.col("path") == F.col("__path"), "full")
    change = F.when(F.col("__path").isNull(), "added").when(F.col("path").isNull(), "gone").when(~F.col("sha256").eqNullSafe(F.col("__sha")), "changed")
    return both.select(F.coalesce("path", "__path").alias("path"), change.alias("change")).filter("change IS NOT NULL")


def updated(before: DataFrame, chunks: DataFrame, after: DataFrame, read: Callable[[DataFrame], DataFrame], snapshot: str, dimension: int = 64, most: int | None = 500) -> Updated:
    """The index of snapshot ``after`` from that of ``before``: the same rows as a whole run, of which only what changed is made.

    ``before``, ``after``: path, sha256; ``chunks``: the old index, as ``index_run`` gives it. ``read`` gets the paths whose
    contents are needed, as rows, and gives path, language, is_binary, content of those files: no other is read, chunked
    or embedded. Chunks of files that stay are taken over, with fingerprints of the new snapshot. Files without a path are left out.
    """
    told = settled(changes(before, after), "changes")
    fresh = index_run(read(told.filter("change <> 'gone'").select("path")), snapshot, dimension, most)
    dead = told.filter("change <> 'added'").select(F.col("path").alias("__dead"))
    stays = chunks.join(dead, F.col("path") == F.col("__dead"), "left_anti")
    print_ = fingerprint(F.lit(snapshot), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content_hash"))
    tombstones = chunks.join(dead, F.col("path") == F.col("__dead"), "left_semi").select("path", "chunk_index")
    return Updated(stays.withColumn("fingerprint", print_).unionByName(fresh), tombstones, told)
