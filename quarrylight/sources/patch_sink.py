"""Patched files as a sink: tasks check and stage, one commit moves, and a journal undoes what did not end."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quarrylight.operators.remediation import protected
from quarrylight.sources.shared import settled

#: The folder of staged files and journals in the tree that is written to.
WORK = ".patches"
OUTCOME = "file_path string, status string, reason string, staged string, original_hash string, target_hash string, mtime long, size long"


def _digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _write(path: str, content: bytes, mode: int | None = None) -> None:
    """Whole or not at all: beside the place first, on disk, then moved."""
    beside = f"{path}.{uuid.uuid4().hex[:8]}"
    with open(beside, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    if mode is not None:
        os.chmod(beside, mode)
    os.replace(beside, path)


@dataclass
class Staged(WriterCommitMessage):
    manifest: str


class PatchWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["root"])
        self.folder = f"{self.root}/{WORK}/{options['batch']}"

    def write(self, rows: Iterator[Row]) -> Staged:
        """Checks each file against the hash that its patch was made for, and stages the new text; nothing outside the batch's folder is touched."""
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.taskAttemptId()}"
        os.makedirs(f"{self.folder}/{name}", exist_ok=True)
        with open(f"{self.folder}/{name}.json", "w") as manifest:
            for n, row in enumerate(rows):
                manifest.write(json.dumps(self._stage(row, f"{name}/{n}")) + "\n")
        return Staged(name)

    def _stage(self, row: Row, place: str) -> dict:
        told = {"file_path": row["file_path"], "original_hash": row["original_hash"], "target_hash": row["target_hash"]}
        target = os.path.realpath(f"{self.root}/{row['file_path']}")
        if not target.startswith(self.root + os.sep) or target.startswith(f"{self.root}/{WORK}{os.sep}"):
            return told | {"status": "FAILED", "reason": "outside"}
        if not os.path.isfile(target):
            return told | {"status": "FAILED", "reason": "missing"}
        seen = os.stat(target)
        with open(target, "rb") as f:
            found = _digest(f.read())
        if found == row["target_hash"]:
            return told | {"status": "APPLIED", "reason": "already"}
        if found != row["original_hash"]:
            return told | {"status": "STALE", "reason": "drifted"}
        content = row["content"].encode()
        if _digest(content) != row["target_hash"]:
            return told | {"status": "FAILED", "reason": "other content"}
        _write(f"{self.folder}/{place}", content, seen.st_mode & 0o7777)
        with open(f"{self.folder}/{place}", "rb") as f:
            if _digest(f.read()) != row["target_hash"]:
                return told | {"status": "FAILED", "reason": "not written"}
        return told | {"status": "APPLIED", "staged": place, "mtime": seen.st_mtime_ns, "size": seen.st_size}

    def commit(self, messages: list[Staged | None]) -> None:
        """Notes which tasks count, moves their files one by one, each atomically, and marks the batch done; on any failure all moves are undone."""
        names = [m.manifest for m in messages if m is not None]
        _write(f"{self.folder}/journal", "\n".join(names).encode())
        try:
            for x in _records(self.folder):
                if x.get("staged"):
                    self._move(x)
            _write(f"{self.folder}/done", b"")
        except BaseException:
            undo(self.folder, self.root)
            raise

    def _move(self, x: dict) -> None:
        target, kept = os.path.realpath(f"{self.root}/{x['file_path']}"), f"{self.folder}/{x['staged']}.old"
        now = os.stat(target)
        if (now.st_mtime_ns, now.st_size) != (x["mtime"], x["size"]):
            raise RuntimeError(f"{x['file_path']} changed while its batch was written")
        os.link(target, kept)  # the old file itself, under another name
        os.replace(f"{self.folder}/{x['staged']}", target)

    def abort(self, messages: list[Staged | None]) -> None:
        undo(self.folder, self.root)


def _records(folder: str) -> Iterator[dict]:
    """What the tasks that count have noted, one row at a time."""
    with contextlib.suppress(FileNotFoundError), open(f"{folder}/journal") as journal:
        for name in journal.read().split("\n"):
            if name:
                with open(f"{folder}/{name}.json") as lines:
                    yield from map(json.loads, lines)


def undo(folder: str, root: str) -> None:
    """Moves back what an unfinished batch has moved, and drops what it staged. Doing it twice does no harm."""
    if os.path.exists(f"{folder}/done"):
        return
    for x in _records(folder):
        kept = f"{folder}/{x.get('staged')}.old"
        if x.get("staged") and os.path.exists(kept):
            os.replace(kept, os.path.realpath(f"{root}/{x['file_path']}"))
    shutil.rmtree(folder, ignore_errors=True)


def recover(root: str) -> list[str]:
    """Undoes every batch that a dead driver left unfinished, and frees the tree; the names of those batches."""
    root = os.path.realpath(root)
    found = []
    for name in sorted(os.listdir(f"{root}/{WORK}")) if os.path.isdir(f"{root}/{WORK}") else []:
        if name != "lock" and not os.path.exists(f"{root}/{WORK}/{name}/done"):
            undo(f"{root}/{WORK}/{name}", root)
            found.append(name)
    with contextlib.suppress(FileNotFoundError):
        os.unlink(f"{root}/{WORK}/lock")
    return found


class PatchSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "patches"

    def schema(self) -> str:
        return "file_path string, original_hash string, target_hash string, content string"

    def writer(self, schema, overwrite: bool) -> PatchWriter:
        return PatchWriter(dict(self.options))


def apply(proposals: DataFrame, root: str) -> DataFrame:
    """proposal_id, file_path, status, reason: what became of each proposal.

    ``proposals``: proposal_id, file_path, state, original_hash, target_hash, content (the whole new text). ``root``: a folder that driver and
    executors share, in which files can be moved atomically.

    Only APPROVED proposals of paths that may be touched are applied; APPLIED ones stay so. A file that is not the one that its
    patch was made for is STALE, and so are further proposals for a file that one (the smallest id) has changed.
    Either all files that passed their checks are changed or, if a task, the commit or the driver
    fails, none is: then ``recover`` puts back what was moved. One batch writes to a tree at a time. Rows without an id or path are refused.
    """
    spark = proposals.sparkSession
    batch = uuid.uuid4().hex
    real = os.path.realpath(root)
    os.makedirs(f"{real}/{WORK}", exist_ok=True)
    try:
        os.close(os.open(f"{real}/{WORK}/lock", os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        raise RuntimeError(f"another batch writes to {root}, or died: recover() then puts it right") from None
    try:
        able = (F.col("state") == "APPROVED") & ~protected(F.col("file_path")) & F.col("proposal_id").isNotNull()
        chosen = proposals.filter(able).groupBy("file_path").agg(F.min_by(F.struct("proposal_id", "original_hash", "target_hash", "content"), "proposal_id").alias("x"))
        chosen = settled(chosen, "patches")  # once, before a file changes
        spark.dataSource.register(PatchSink)
        chosen.select("file_path", "x.original_hash", "x.target_hash", "x.content").write.format("patches").option("root", root).option("batch", batch).mode("append").save()
        first = chosen.select(F.col("x.proposal_id").alias("__id"))
        noted = outcome(spark, root, batch)
    finally:
        os.unlink(f"{real}/{WORK}/lock")
    rows = proposals.select("proposal_id", "file_path", "state", able.alias("able")).join(first, F.col("proposal_id") == F.col("__id"), "left")
    met = rows.join(noted.select(F.col("file_path").alias("__path"), "status", "reason"), F.col("file_path") == F.col("__path"), "left")
    mine = F.col("__id").isNotNull()
    status = F.when(F.coalesce("able", F.lit(False)), F.when(mine, F.col("status")).when(F.col("status").isNotNull(), "STALE")).when(F.col("state") == "APPLIED", "APPLIED").otherwise("REFUSED")
    why = F.when(F.coalesce("able", F.lit(False)), F.when(mine, F.col("reason")).otherwise("another came first")).when(F.col("state") == "APPLIED", "already").when(F.col("state") == "APPROVED", "protected").otherwise("not approved")
    return met.select("proposal_id", "file_path", status.alias("status"), why.alias("reason"))


def outcome(spark: SparkSession, root: str, batch: str) -> DataFrame:
    """The notes of a batch that was committed, as rows."""
    folder = f"{os.path.realpath(root)}/{WORK}/{batch}"
    with open(f"{folder}/journal") as journal:
        names = [f"file://{folder}/{n}.json" for n in journal.read().split("\n") if n]
    return spark.read.schema(OUTCOME).json(names) if names else spark.createDataFrame([], OUTCOME)
