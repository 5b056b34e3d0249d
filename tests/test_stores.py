"""Patched trees that fail half way, damaged copies, sweeps against plain loops, versions as bytes."""

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import versions as vs
from quarrylight.operators import sweeps
from quarrylight.sources import copies, patch_sink

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
PATCH = "proposal_id long, file_path string, state string, original_hash string, target_hash string, content string"


def tree(root):
    return {os.path.relpath(p, root): open(p).read() for p in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(p)}


def patched(spark, root, rows, parts=3):
    frame = spark.createDataFrame(rows, PATCH).repartition(parts)
    return {r["proposal_id"]: (r["status"], r["reason"]) for r in patch_sink.apply(frame, str(root)).collect()}


def test_patches(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.txt").write_text(f"old {i}\n")
    (tmp_path / "5.txt").chmod(0o755)
    os.symlink("/etc/hostname", tmp_path / "out")
    row = lambda i, path, old, new, state="APPROVED": (i, path, state, sha(old), sha(new), new)
    rows = [row(0, "0.txt", "old 0\n", "new 0"), row(1, "0.txt", "old 0\n", "other"), row(2, "1.txt", "older\n", "n"), row(3, "none.txt", "", "n"), row(4, "out", "x", "y"), row(5, "../up", "x", "y"),
            row(6, "2.txt", "old 2\n", "n", "VALIDATED"), row(7, "3.txt", "old 3\n", "n", "APPLIED"), row(8, "5.txt", "old 5\n", "#!new"), row(9, "a/.env", "x", "y"), (None, "4.txt", "APPROVED", sha("old 4\n"), sha("n"), "n")]
    got = patched(spark, tmp_path, rows)
    assert got == {0: ("APPLIED", None), 1: ("STALE", "another came first"), 2: ("STALE", "drifted"), 3: ("FAILED", "missing"), 4: ("FAILED", "outside"), 5: ("REFUSED", "protected"), 6: ("REFUSED", "not approved"), 7: ("APPLIED", "already"), 8: ("APPLIED", None), 9: ("REFUSED", "protected"), None: ("REFUSED", "protected")}
    assert (tmp_path / "0.txt").read_text() == "new 0" and (tmp_path / "4.txt").read_text() == "old 4\n" and (tmp_path / "5.txt").stat().st_mode & 0o777 == 0o755
    assert patched(spark, tmp_path, rows[:1]) == {0: ("APPLIED", "already")}
    assert patched(spark, tmp_path, []) == {}


def test_a_failed_task_changes_nothing(spark, tmp_path, monkeypatch):
    for i in range(9):
        (tmp_path / f"{i}.txt").write_text(f"old {i}\n")
    before = tree(tmp_path)
    rows = [(i, f"{i}.txt", "APPROVED", sha(f"old {i}\n"), sha("new"), "new" if i != 7 else None) for i in range(9)]  # null content: the task dies
    with pytest.raises(Exception, match="NoneType"):
        patched(spark, tmp_path, rows, 9)
    assert tree(tmp_path) == before


def test_a_commit_that_dies_is_undone(tmp_path, monkeypatch):
    """A changed file in the middle of the moves undoes those before it; a dead driver's batch is undone by recover."""
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"old {i}\n")
    before = tree(tmp_path)

    def staged(batch):
        writer = patch_sink.PatchWriter({"root": str(tmp_path), "batch": batch})
        monkeypatch.setattr(patch_sink.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 0})())
        return writer, writer.write({"file_path": f"{i}.txt", "original_hash": sha(f"old {i}\n"), "target_hash": sha("new"), "content": "new"} for i in range(5))

    writer, message = staged("a")
    (tmp_path / "3.txt").write_text("mine!\n")
    with pytest.raises(RuntimeError, match="changed while"):
        writer.commit([message])
    assert tree(tmp_path) == before | {"3.txt": "mine!\n"}
    (tmp_path / "3.txt").write_text("old 3\n")
    writer, message = staged("b")
    moves, own = [], patch_sink.PatchWriter._move

    def twice(self, x):
        if len(moves) == 2:
            raise SystemExit
        moves.append(x)
        own(self, x)

    monkeypatch.setattr(patch_sink.PatchWriter, "_move", twice)
    monkeypatch.setattr(patch_sink, "undo", lambda folder, root, own=patch_sink.undo: None)  # the driver is dead
    with pytest.raises(SystemExit):
        writer.commit([message])
    monkeypatch.undo()
    assert sum(v == "new" for v in tree(tmp_path).values()) == 2
    assert patch_sink.recover(str(tmp_path)) == ["b"] and tree(tmp_path) == before and patch_sink.recover(str(tmp_path)) == []


def test_one_batch_at_a_time(spark, tmp_path):
    (tmp_path / patch_sink.WORK).mkdir()
    (tmp_path / patch_sink.WORK / "lock").write_text("")
    with pytest.raises(RuntimeError, match="another batch"):
        patched(spark, tmp_path, [])
    patch_sink.recover(str(tmp_path))
    assert patched(spark, tmp_path, []) == {}


def test_copies(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"n{i}", {"b": i, "a": 1} if i % 2 else None, [i, None]) for i in range(500)]
    frame = spark.createDataFrame(rows + rows[:20], "id long, name string, tags map<string,int>, `a b` array<int>")
    place = f"{tmp_path}/copy"
    root = copies.copy(frame, place, ["id"])
    assert root and copies.copy(frame.repartition(11), f"{tmp_path}/other", ["id"]) == root and copies.verify(spark, place).count() == 0
    assert copies.restore(spark, place, f"{tmp_path}/back").count() == 520
    with pytest.raises(Exception, match="exists"):
        copies.restore(spark, place, f"{tmp_path}/back")

    def damaged(df):
        folder = copies.manifest(spark, place)["folder"]
        df.write.parquet(f"{tmp_path}/tmp")
        for f in glob.glob(f"{place}/{folder}/*.parquet") + glob.glob(f"{place}/{folder}/.*.crc"):
            os.unlink(f)
        for f in glob.glob(f"{tmp_path}/tmp/*.parquet"):
            os.rename(f, f"{place}/{folder}/{os.path.basename(f)}")
        found = {r["leaf"]: r["verdict"] for r in copies.verify(spark, place).collect()}
        os.rename(f"{tmp_path}/tmp", f"{tmp_path}/tmp{random.random()}")
        return found

    leaf = {r["id"]: r["leaf"] for r in frame.select("id", copies.leaf_of(["id"]).alias("leaf")).collect()}
    whole = [r for r in frame.collect()]
    of = lambda kept: spark.createDataFrame(kept, frame.schema)
    assert damaged(of([r for r in whole if r["id"] != 33])) == {leaf[33]: "lost"}
    assert damaged(of([*whole, whole[77]])) == {leaf[77]: "added"}
    assert damaged(of([(r[0], "x", *r[2:]) if r["id"] == 40 else r for r in whole])) == {leaf[40]: "changed"}
    assert damaged(of(whole)) == {}
    with pytest.raises(OSError, match="damaged"):
        damaged(of(whole[1:]))
        copies.restore(spark, place, f"{tmp_path}/never")
    assert copies.copy(frame.limit(0), f"{tmp_path}/none", ["id"]) == "" and copies.verify(spark, f"{tmp_path}/none").count() == 0


def test_differences(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "n"), (5, "e")], "id int, x string")
    b = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, ""), (None, "n"), (6, "f")], "id int, x string")
    assert {tuple(r) for r in copies.differences(a, b, ["id"]).collect()} == {(1, "lost"), (2, "repeated"), (3, "changed"), (5, "lost"), (6, "added")}
    assert copies.differences(a, a.repartition(3), ["id"]).count() == 0


def test_first_conflicts(spark):
    """10^5 spans of one file: at most a row a span, and the first pair is one of the pair list's."""
    rng = random.Random(3)
    spans = [("f" if i % 10 else f"g{i % 7}", i, s := rng.randrange(3_000_000), s + rng.randrange(40)) for i in range(100_000)] + [("g", 1, None, 3), ("g", 2, 1, 2)]
    got = {(r["f"], r["i"]): r["conflict"] for r in sweeps.first_conflicts(spark.createDataFrame(spans, "f string, i long, a long, b long").repartition(8), "f", "i", "a", "b").collect()}
    want, reach = {}, {}
    for f, i, a, b in sorted((s for s in spans if s[2] is not None), key=lambda s: (s[0], s[2], s[3], s[1])):
        if f in reach and reach[f][0] >= a:
            want[f, i] = reach[f][1]
        reach[f] = max(reach.get(f, (b, i)), (b, i))
    assert got == want and 0 < len(got) <= len(spans)


def test_points_in_intervals(spark):
    rng = random.Random(5)
    points = [("hot" if i % 3 else f"p{i % 4}", rng.randrange(4000)) for i in range(9000)] + [(None, 5), ("hot", None)]
    ranges = [(i, "hot" if i % 2 else rng.choice(["p0", "p1", "zz", None]), rng.choice([None, rng.randrange(4000)]), rng.choice([None, rng.randrange(4000)]), i % 3 == 0) for i in range(120)]
    got = sorted((r["g"], r["x"], r["k"]) for r in sweeps.points_in_intervals(spark.createDataFrame(points, "g string, x long").repartition(6), spark.createDataFrame(ranges, "k long, g string, lo long, hi long, c boolean"), "g", "x", "k", "lo", "hi", "c").filter("g IS NOT NULL").collect())
    want = sorted((g, x, k) for g, x in {p for p in points if p[1] is not None and p[0]} for k, of, lo, hi, c in ranges if of == g and (lo is None or x >= lo) and (hi is None or x < hi or (c and x == hi)))
    assert got == want and len(got) > 1000


def test_version_bytes(spark):
    """The order of bytes is the order of keys, on random versions of both kinds."""
    rng = random.Random(9)
    number = lambda: str(rng.choice([0, 1, 2, 9, 10, 11, 99, 100, 12345678]))
    name = lambda: rng.choice(["a", "alpha", "b", "rc", "x-y", "0a", "A", number()])
    semver = {".".join(number() for _ in range(3)) + ("-" + ".".join(name() for _ in range(rng.randrange(1, 4))) if rng.random() < 0.6 else "") for _ in range(600)}
    python = {rng.choice(["", "1!"]) + ".".join(number() for _ in range(rng.randrange(1, 5))) + rng.choice(["", f"a{number()}", f"rc{number()}", "b"]) + rng.choice(["", "", f".post{number()}"]) + rng.choice(["", "", f".dev{number()}"]) + rng.choice(["", "", "+local.1", f"+{number()}", "+ab"]) for _ in range(600)}
    for texts, key, as_bytes in ((semver, vs.semver_key, vs.semver_bytes), (python, vs.pep440_key, vs.pep440_bytes)):
        frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", key(F.col("t")).alias("k")).filter("k IS NOT NULL").select("t", "k", as_bytes(F.col("k")).alias("b")).cache()
        by_key = [r["t"] for r in frame.orderBy("k", "t").collect()]
        by_bytes = [r["t"] for r in frame.orderBy("b", "t").collect()]
        assert by_key == by_bytes and len(by_key) > 400
        assert frame.select(F.count_distinct("k") == F.count_distinct("b")).first()[0]
