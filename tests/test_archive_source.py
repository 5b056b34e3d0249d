"""Archives made here, read as rows: contents, bounds while reading, broken files, ranges of large zips."""

import io
import os
import tarfile
import zipfile

import pytest

from quarrylight.sources import archive_source
from quarrylight.sources.archives import Limits


def tar(path, files, links=(), mode="w:gz"):
    with tarfile.open(path, mode) as t:
        for name, content in files:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
        for name, target in links:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, target
            t.addfile(info)


def zipped(path, files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(name, content)


def told(spark, path, **bounds):
    """{archive: {path: content}}, {archive: why it is refused}."""
    limits = Limits(**bounds)
    rows = archive_source.unpacked(archive_source.members(spark, f"file://{path}", limits), limits).collect()
    kept = {}
    for r in rows:
        if r["refused"] is None:
            kept.setdefault(os.path.basename(r["archive"]), {})[r["path"]] = bytes(r["content"])
    return kept, {os.path.basename(r["archive"]): r["refused"] for r in rows if r["refused"]}


def test_contents(spark, tmp_path):
    files = [("repo/a.py", b"x = 1\n"), ("repo/sub/b.txt", b""), ("repo/c.bin", bytes(range(256)))]
    for mode, end in (("w", "tar"), ("w:gz", "tar.gz"), ("w:bz2", "tar.bz2"), ("w:xz", "tar.xz")):
        tar(tmp_path / f"t.{end}", files, [("repo/l", "a.py"), ("repo/out", "../../etc/passwd")], mode)
    zipped(tmp_path / "z.zip", [*files, ("repo/dir/", b"")])
    zipped(tmp_path / "two.zip", [("a/x", b"1"), ("b/y", b"2")])
    tar(tmp_path / "over.tgz", [("r/x", b"old"), ("r/x", b"new")])
    (tmp_path / "notes.txt").write_text("no archive")
    kept, refused = told(spark, tmp_path)
    below = {n.removeprefix("repo/"): c for n, c in files}
    assert not refused and all(kept[n] == below for n in ("t.tar", "t.tar.gz", "t.tar.bz2", "t.tar.xz", "z.zip"))
    assert kept["two.zip"] == {"a/x": b"1", "b/y": b"2"} and kept["over.tgz"] == {"x": b"new"}


def test_refused(spark, tmp_path):
    zero = bytes(1 << 19)
    tar(tmp_path / "up.tgz", [("ok", b"1"), ("../evil", b"2")])
    zipped(tmp_path / "drive.zip", [("C:/x", b"1")])
    tar(tmp_path / "large.tgz", [("r/big", bytes((1 << 20) + 1))])
    zipped(tmp_path / "bomb.zip", [(f"r/{i}", zero) for i in range(8)])
    tar(tmp_path / "bomb.tgz", [(f"r/{i}", zero) for i in range(8)])
    zipped(tmp_path / "many.zip", [(f"r/{i}", b"") for i in range(60)])
    tar(tmp_path / "both.tgz", [("r/x", b"1")])
    (tmp_path / "torn.tgz").write_bytes((tmp_path / "up.tgz").read_bytes()[:-30])
    (tmp_path / "none.zip").write_bytes(b"PK nothing")
    kept, refused = told(spark, tmp_path, files=50)
    assert refused == {"up.tgz": "escapes", "drive.zip": "escapes", "large.tgz": "too_large", "bomb.zip": "expands_too_much", "bomb.tgz": "expands_too_much", "many.zip": "too_many_files", "torn.tgz": "broken", "none.zip": "broken"}
    assert kept == {"both.tgz": {"x": b"1"}}


def test_a_bomb_stops_early(tmp_path, monkeypatch):
    """Of 400 MB of zeros in half a megabyte no more is decompressed than the bounds allow, and a false size does not help."""
    tar(tmp_path / "b.tgz", [(f"r/{i}", bytes(1 << 20)) for i in range(400)])
    read = []
    own = archive_source.Bounded.read
    monkeypatch.setattr(archive_source.Bounded, "read", lambda self, n=-1: read.append(len(out := own(self, n))) or out)
    reader = archive_source.ArchiveReader({"path": f"file://{tmp_path}/b.tgz"})
    (piece,) = reader.partitions()
    rows = list(reader.read(piece))
    assert rows[-1][-1] == "expands_too_much" and sum(read) < 20 << 20
    zipped(tmp_path / "lie.zip", [("r/x", os.urandom(3000))])
    raw = bytearray((tmp_path / "lie.zip").read_bytes())
    at = raw.rindex(b"PK\x01\x02")
    raw[at + 24 : at + 28] = (100).to_bytes(4, "little")  # the list claims 100 bytes
    (tmp_path / "lie.zip").write_bytes(raw)
    reader = archive_source.ArchiveReader({"path": f"file://{tmp_path}/lie.zip"})
    assert [r[-1] for p in reader.partitions() for r in reader.read(p)] in (["too_large"], ["broken"])


def test_ranges_of_a_large_zip(spark, tmp_path):
    files = [(f"r/{i:03}", os.urandom(4000)) for i in range(100)]
    zipped(tmp_path / "z.zip", files)
    reader = archive_source.ArchiveReader({"path": f"file://{tmp_path}", "split": "40000"})
    pieces = reader.partitions()
    assert len(pieces) > 8
    rows = [r for p in pieces for r in reader.read(p)]
    assert [(r[3], r[7]) for r in rows] == files and [r[2] for r in rows] == list(range(100))
    got = archive_source.members(spark, f"file://{tmp_path}", split=40_000)
    assert got.rdd.getNumPartitions() == len(pieces) and got.count() == 100


@pytest.mark.parametrize("name", ["empty.zip", "empty.tar"])
def test_empty(spark, tmp_path, name):
    zipped(tmp_path / name, []) if name.endswith("zip") else tar(tmp_path / name, [], mode="w")
    assert told(spark, tmp_path) == ({}, {})
