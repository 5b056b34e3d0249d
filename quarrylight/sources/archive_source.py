"""Archives as a data source: members of tar and zip files as rows, unpacked under limits while they are read."""

from __future__ import annotations

import bz2
import gzip
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylight.sources.archives import Limits, admitted, judged, single_root
from quarrylight.sources.shared import settled

SCHEMA = "archive string, archive_bytes long, ordinal long, member string, kind string, link string, size long, content binary, refused string"
TAR_ENDS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
#: Bytes of a tar beside its files' contents, for each file that may be in it.
HEADER = 2048
STEP = 1 << 16
#: Archives of one task.
TOGETHER = 64


class Refused(Exception):
    """An archive must not be unpacked; the argument says why."""


class Sought:
    """An Arrow file as ``zipfile`` asks for it: a place before the start is an ``OSError``."""

    def __init__(self, file: BinaryIO):
        self.read, self.tell, self.file = file.read, file.tell, file

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e


class Bounded:
    """A stream that is refused once it has given too many bytes, whatever they are said to be."""

    def __init__(self, stream: BinaryIO, most: int):
        self.stream, self.left = stream, most

    def read(self, n: int = -1) -> bytes:
        parts, wanted = [], n
        while wanted and (got := self.stream.read(min(wanted, STEP) if n >= 0 else STEP)):
            self.left -= len(got)
            if self.left < 0:
                raise Refused("too_many_bytes")
            parts.append(got)
            wanted -= len(got)
        return b"".join(parts)


class Meter:
    """Counts what an archive unpacks to, and refuses it at the first bound that it passes."""

    def __init__(self, limits: Limits, packed: int):
        self.limits, self.packed, self.files, self.bytes = limits, packed, 0, 0

    def file(self, size: int) -> None:
        self.files += 1
        if self.files > self.limits.files:
            raise Refused("too_many_files")
        if size > self.limits.each:
            raise Refused("too_large")

    def content(self, stream: BinaryIO, size: int) -> bytes:
        """The whole content, step by step; one that goes on behind the size it claims is refused."""
        parts, got = [], 0
        while chunk := stream.read(STEP):
            got += len(chunk)
            self.bytes += len(chunk)
            if got > min(size, self.limits.each):
                raise Refused("too_large")
            if self.bytes > self.limits.total:
                raise Refused("too_many_bytes")
            if self.packed > 0 and self.bytes > self.limits.small and self.bytes / self.packed > self.limits.ratio:
                raise Refused("expands_too_much")
            parts.append(chunk)
        return b"".join(parts)


@dataclass
class Piece(InputPartition):
    """Archives of one task: path, size, and the members from ``start`` to ``end``; ``end`` -1 is to the last."""

    archives: list[tuple[str, int, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split", 64 << 20))
        known = asdict(Limits())
        self.limits = replace(Limits(), **{k: type(known[k])(options[k]) for k in known if k in options})

    def partitions(self) -> list[Piece]:
        """Small archives go together, up to TOGETHER or ``split`` bytes of them; the members of a zip of more are shared out by its list of members."""
        files, base = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(base)
        listed = files.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
        pieces, held, size = [], [], 0
        for x in sorted((x for x in listed if x.type == fs.FileType.File and x.path.lower().endswith((*TAR_ENDS, ".zip"))), key=lambda x: x.path):
            if x.size > self.split and x.path.lower().endswith(".zip"):
                pieces += [Piece([(x.path, x.size, a, b)]) for a, b in self._ranges(files, x)]
                continue
            if held and (size + x.size > self.split or len(held) >= TOGETHER):
                pieces.append(Piece(held))
                held, size = [], 0
            held.append((x.path, x.size, 0, -1))
            size += x.size
        return [*pieces, Piece(held)]

    def _ranges(self, files: fs.FileSystem, x: fs.FileInfo) -> list[tuple[int, int]]:
        """Runs of members of about ``split`` packed bytes. The sizes that the list claims are checked for the whole archive here, and each content against its claim where it is read."""
        try:
            with files.open_input_file(x.path) as f, zipfile.ZipFile(Sought(f)) as z:
                members = z.infolist()
        except (zipfile.BadZipFile, OSError):
            return [(0, -1)]
        if self._claims(members, x.size):
            return [(0, -1)]  # one task tells why
        cuts, size = [0], 0
        for i, m in enumerate(members):
            if size and size + m.compress_size > self.split:
                cuts.append(i)
                size = 0
            size += m.compress_size
        return list(zip(cuts, [*cuts[1:], len(members)], strict=True))

    def _claims(self, members: list[zipfile.ZipInfo], packed: int) -> str | None:
        sizes = [m.file_size for m in members if not m.is_dir()]
        if len(sizes) > self.limits.files:
            return "too_many_files"
        if max(sizes, default=0) > self.limits.each:
            return "too_large"
        if sum(sizes) > self.limits.total:
            return "too_many_bytes"
        return "expands_too_much" if packed and sum(sizes) > self.limits.small and sum(sizes) / packed > self.limits.ratio else None

    def read(self, piece: Piece) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.path)
        for path, size, start, end in piece.archives:
            at, member = start, None
            try:
                for at, member, *rest in self._zip(files, path, size, start, end) if path.lower().endswith(".zip") else self._tar(files, path, size):
                    yield (path, size, at, member, *rest, None)
            except Refused as e:
                yield (path, size, at + 1, None, None, None, None, None, e.args[0])
            except (tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, NotImplementedError, RuntimeError, ValueError):
                yield (path, size, at + 1, None, None, None, None, None, "broken")

    def _tar(self, files: fs.FileSystem, path: str, size: int) -> Iterator[tuple]:
        meter = Meter(self.limits, size)
        with files.open_input_stream(path, compression=None) as raw:
            low = path.lower()
            opened = gzip.open(raw) if low.endswith(("gz", "tgz")) else bz2.open(raw) if low.endswith("bz2") else lzma.open(raw) if low.endswith("xz") else raw
            stream = Bounded(opened, self.limits.total + HEADER * (self.limits.files + 8))
            with tarfile.open(fileobj=stream, mode="r|") as tar:
                for at, m in enumerate(tar):
                    if m.isfile():
                        meter.file(m.size)
                        yield at, m.name, "file", None, m.size, meter.content(tar.extractfile(m), m.size)
                    elif m.isdir():
                        yield at, m.name, "directory", None, 0, None
                    elif m.issym() or m.islnk():
                        yield at, m.name, "link", m.linkname, 0, None

    def _zip(self, files: fs.FileSystem, path: str, size: int, start: int, end: int) -> Iterator[tuple]:
        with files.open_input_file(path) as f, zipfile.ZipFile(Sought(f)) as z:
            members = z.infolist()
            if reason := self._claims(members, size):
                raise Refused(reason)
            # A range has no more than its archive's claims, which have been added up.
            meter = Meter(self.limits, size)
            for at in range(start, len(members) if end < 0 else end):
                m = members[at]
                if m.is_dir():
                    yield at, m.filename, "directory", None, 0, None
                    continue
                meter.file(m.file_size)
                with z.open(m) as content:
                    yield at, m.filename, "file", None, m.file_size, meter.content(content, m.file_size)


class ArchiveSource(DataSource):
    """``spark.read.format("archives")``: options ``path`` (a file or folder), ``split``, and the fields of ``Limits``."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def members(spark: SparkSession, path: str, limits: Limits = Limits(), split: int = 64 << 20) -> DataFrame:
    """A row for every member of the tar and zip files under ``path``, with its content; folders and links have none.

    A task reads some archives, or a run of a large zip's members, as streams, and holds one member. Bytes, files, sizes and expansion
    are bounded while they are read: an archive that passes a bound, or is broken, ends in a
    row without a member whose ``refused`` says why, and nothing behind it is read. Empty archives give no row.
    ``path`` is one that Arrow's file systems can open from every node.
    """
    spark.dataSource.register(ArchiveSource)
    options = {k: str(v) for k, v in asdict(limits).items()} | {"path": path, "split": str(split)}
    return spark.read.format("archives").options(**options).load()


def unpacked(read: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """archive, path, size, content of all files of archives that nothing speaks against; archive and refused of the others.

    ``read``: the rows of ``members``. One folder that holds all there is falls away from
    the paths. Of members with one path the last counts, as if it had been written over. Members are judged without their
    contents; the contents are read twice from the shared folder and decompressed once.
    """
    rows = settled(read, "members")
    plain = rows.filter("refused IS NULL").drop("content")
    told = settled(judged(plain, limits), "judged")
    stopped = rows.filter("refused IS NOT NULL").select("archive", "refused").unionByName(admitted(plain, limits).filter("refused IS NOT NULL").select("archive", "refused"))
    stopped = settled(stopped.groupBy("archive").agg(F.min("refused").alias("refused")), "stopped")
    of = stopped.select(F.col("archive").alias("__stopped"))
    named = told.filter("verdict = 'ok'").select(F.col("archive").alias("__a"), F.col("member").alias("__m"), "path").distinct()
    roots = single_root(told.join(of, F.col("archive") == F.col("__stopped"), "left_anti")).select(F.col("archive").alias("__r"), "root")
    files = rows.filter("kind = 'file'").join(of, F.col("archive") == F.col("__stopped"), "left_anti")
    met = files.join(named, (F.col("archive") == F.col("__a")) & (F.col("member") == F.col("__m"))).join(roots, F.col("archive") == F.col("__r"))
    below = F.when(F.col("root").isNotNull(), F.substring("path", F.length("root") + 2, F.length("path"))).otherwise(F.col("path"))
    last = met.groupBy("archive", below.alias("path")).agg(F.max_by(F.struct("size", "content"), "ordinal").alias("x"))
    kept = last.select("archive", "path", "x.size", "x.content", F.lit(None).cast("string").alias("refused"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("size", "long"), ("content", "binary"))]
    return kept.unionByName(stopped.select("archive", *none, "refused"))
