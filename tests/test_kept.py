"""Kept indexes against scores worked out here, incremental against whole runs, swaps at once."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.text import code_tokens, words
from quarrylight.operators import chunking, increments, kept_index, retrieval, sweeps
from quarrylight.sources import advisory_data, journal


def test_kept_index(spark, tmp_path, monkeypatch):
    """Equal hits, and far from all blocks read where scores differ."""
    monkeypatch.setattr(kept_index, "STRATUM", 16)
    rng = random.Random(3)
    docs = {i: " ".join(["rare"] * (i % 97 == 0) * rng.randrange(1, 4) + rng.choices(["the", "and", "of", "word", "long"], k=rng.choice([2, 3, 8, 60]))) for i in range(1500)} | {2000: None, 2001: ""}
    frame = spark.createDataFrame(list(docs.items()), "id long, text string").repartition(6)
    base = str(tmp_path / "index")
    assert kept_index.build(frame.limit(3), base, "id", words(F.col("text"))) == 1
    assert kept_index.build(frame, base, "id", words(F.col("text"))) == 2
    tokens = {i: (t or "").split() for i, t in docs.items()}
    n, average = len(docs), sum(map(len, tokens.values())) / len(docs)

    def score(i, query):
        total = 0
        for t in query:
            tf, df = tokens[i].count(t), sum(t in x for x in tokens.values())
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[i]) / average))
        return total

    for query in (["rare"], ["rare", "the"], ["the", "and", "the"], ["none"], []):
        found = kept_index.top(spark, base, query, 10)
        want = sorted((-round(score(i, query), 9), i) for i in docs if score(i, query) > 0.001)[:10]
        assert [(-round(r["raw_score"], 9), r["key"]) for r in found.hits.collect()] == want
        assert found.read <= found.blocks
        if query == ["rare", "the"]:
            assert 0 < found.read < 0.6 * found.blocks


def test_increments(spark):
    """Random edits; the index is that of a whole run, and no file that stays is read."""
    rng = random.Random(7)
    old = {f"{i}.txt": f"text {i}\n" * rng.randrange(1, 4) for i in range(60)}
    new = {p: t for p, t in old.items() if rng.random() < 0.8}
    new |= {p: t + "more\n" for p, t in new.items() if rng.random() < 0.2} | {f"n{i}.txt": f"new {i}" for i in range(9)}
    kind = "path string, content string"
    frame = lambda files: spark.createDataFrame(list(files.items()), kind).select("path", F.lit(None).cast("string").alias("language"), F.lit(False).alias("is_binary"), "content")
    hashed = lambda files: frame(files).select("path", F.sha2("content", 256).alias("sha256"))
    asked = []

    def read(paths):
        asked.extend(r["path"] for r in paths.collect())
        return frame({p: new[p] for p in asked}) if asked else frame(new).limit(0)

    chunks = chunking.index_run(frame(old), "s1", 8)
    made = increments.updated(hashed(old), chunks, hashed(new), read, "s2", 8)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    assert rows(made.chunks) == rows(chunking.index_run(frame(new), "s2", 8))
    assert sorted(asked) == sorted(p for p in new if new[p] != old.get(p))
    assert {r["path"] for r in made.tombstones.collect()} == {p for p in old if new.get(p) != old[p]}
    assert {(r["path"], r["change"]) for r in made.changes.collect()} == {(p, "added" if p not in old else "gone" if p not in new else "changed") for p in old | new if old.get(p) != new.get(p)}


def test_two_swaps_at_once(spark, tmp_path):
    base = f"file://{tmp_path}/sets"
    numbers, failed = [], []

    def write(i):
        try:
            numbers.append(journal.append(spark, f"{base}/log", {"version": f"v{i}", "path": str(i), "records": i, "since": "2026-01-01T00:00:00Z"}, expected=None if i < 6 else 0))
        except RuntimeError:
            failed.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == list(range(1, len(numbers) + 1)) and len(numbers) + len(failed) == 8 and len(numbers) >= 6
    told = advisory_data.status(spark, base).collect()
    assert [r["number"] for r in told if r["state"] == "active"] == [max(numbers)] and len({r["version"] for r in told}) == len(numbers)


def test_a_swap_that_lost_is_refused(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(3)
    advisory_data.swap(rows, base, "1", expected=0)
    advisory_data.swap(rows.limit(1), base, "2", expected=1)
    with pytest.raises(RuntimeError, match="came after"):
        advisory_data.swap(rows, base, "3", expected=1)
    assert advisory_data.current(spark, base).count() == 1


def test_code_counts(spark):
    """Counted by token or by occurrence, texts have the same code tokens."""
    rng = random.Random(11)
    parts = ["web", "Thing", "HTTP", "server", "ing", "ation", "ed", "es", "s", "ss", "_", "__", "2", "X", "getXMLHttp", "caches", "created", "classes", "é", " ", "-"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(300)] + ["", None, "creation passing beds"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    terms = ["web", "thing", "create", "http", "class", "get", "xml", "2", "pass", "none"]
    of = F.col("found")
    want = frame.select("t", code_tokens(F.col("t")).alias("found")).select("t", F.size(of).cast("long").alias("n"), F.array(*[F.size(F.array_compact(F.transform(of, _same(q)))).cast("long") for q in terms]).alias("times"))
    got = frame.select("t", retrieval.code_counts(F.col("t"), terms).alias("c")).select("t", "c.len", "c.times")
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def _same(term):
    return lambda x: F.when(x == term, x)


def test_an_index_holds_each_term_of_each_row_once(spark, tmp_path):
    """Rows that share a key are rows of their own; a term's blocks together name as many rows as hold it."""
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (2, ["b", "c"]), (3, None)], "k long, words array<string>")
    kept_index.build(docs, f"file://{tmp_path}/index", "k", F.col("words"))
    (place,) = [p for p in tmp_path.glob("index/*/blocks")]
    blocks = spark.read.parquet(f"file://{place}").collect()
    assert sorted((b["term"], r["key"], r["tf"], r["len"]) for b in blocks for r in b["rows"]) == [("a", 1, 1, 1), ("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 2), ("c", 2, 1, 2)]
    assert sum(b["n"] for b in blocks) == 5


def test_blocks_of_a_sweep_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "BLOCK", 100)
    rows = spark.range(3000).select(F.lit("one").alias("g"), ((F.col("id") * 7) % 3000).alias("v"))
    sizes = [r["count"] for r in sweeps.blocked(rows, ["g"], ["v"]).groupBy("__block").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400
    assert all(r["rank"] == r["v"] for r in sweeps.ranked(rows, ["g"], ["v"]).collect())
