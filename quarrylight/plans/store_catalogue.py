"""Queries on what is kept: archives, patched trees, copies, and sweeps over sorted rows."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from quarrylight.functions import versions as vs
from quarrylight.operators import sweeps
from quarrylight.plans.registry import query, table
from quarrylight.sources import archive_source, copies, discovery, patch_sink
from quarrylight.sources.shared import settled, shared_dir

# --- archives ------------------------------------------------------------------------------------


def _archived(folder: str):
    """Writes an archive of a few rows: every other one a zip, and some with a member that must not be."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["archive"].iloc[0])
        files = [(f"repo-{number}/src/{k}.txt", f"{k} {name}\n".encode()) for k, name in sorted(zip(rows["p_partkey"], rows["p_name"], strict=True))]
        files += {3: [("repo/../../evil", b"x")], 5: [("big", bytes((1 << 20) + 1))], 6: [(f"zero{i}", bytes(900_000)) for i in range(2)]}.get(number % 8, [])
        place = f"{folder}/{number}.{'zip' if number % 2 else 'tar.gz'}"
        beside = f"{folder}/{uuid.uuid4().hex}.part"
        if number % 2:
            with zipfile.ZipFile(beside, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in files:
                    z.writestr(name, content)
        else:
            with tarfile.open(beside, "w:gz") as t:
                for name, content in files:
                    info = tarfile.TarInfo(name)
                    info.size = len(content)
                    t.addfile(info, io.BytesIO(content))
        os.replace(beside, place)
        return pd.DataFrame({"archive": [number]})

    return write


def _local_folder(spark, name: str) -> str:
    """A new folder in the shared one; these queries need one that is a path of files."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file://")
    os.makedirs(folder)
    return folder


@query(r"""WITH m AS (SELECT p_partkey // 16 AS archive, p_partkey AS k, p_name FROM part)
SELECT archive::INT AS archive, 'src/' || k || '.txt' AS path, strlen(k || ' ' || p_name || chr(10))::BIGINT AS size, sha256(k || ' ' || p_name || chr(10)) AS sha256, NULL::VARCHAR AS refused FROM m WHERE archive % 8 NOT IN (3, 5, 6)
UNION ALL SELECT DISTINCT archive::INT, NULL, NULL, NULL, CASE archive % 8 WHEN 3 THEN 'escapes' WHEN 5 THEN 'too_large' ELSE 'expands_too_much' END FROM m WHERE archive % 8 IN (3, 5, 6)""")
def unpacked_archives(spark, d):
    """All parts, packed by tasks sixteen to an archive, read back through the data source and unpacked under its bounds."""
    folder = _local_folder(spark, "archives")
    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 16).cast("int").alias("archive"), "p_partkey", "p_name")
    rows.groupBy("archive").applyInPandas(_archived(folder), "archive int").write.format("noop").mode("overwrite").save()
    found = archive_source.unpacked(archive_source.members(spark, f"file://{folder}"))
    number = F.regexp_extract("archive", r"/(\d+)\.[^/]+$", 1).cast("int")
    return found.select(number.alias("archive"), "path", "size", F.sha2("content", 256).alias("sha256"), "refused")


# --- patched trees -------------------------------------------------------------------------------


@query("""WITH f AS (SELECT p_partkey // 8 AS k, string_agg(p_partkey || ' ' || p_name, chr(10) ORDER BY p_partkey) || chr(10) AS old FROM part GROUP BY 1),
s AS (SELECT *, CASE k % 8 WHEN 4 THEN '.env.' || k ELSE 'src/' || k || '.txt' END AS path FROM f)
SELECT k::BIGINT AS proposal_id, path AS file_path, CASE k % 8 WHEN 1 THEN 'STALE' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'REFUSED' WHEN 5 THEN 'REFUSED' ELSE 'APPLIED' END AS status,
CASE k % 8 WHEN 1 THEN 'drifted' WHEN 2 THEN 'other content' WHEN 3 THEN 'missing' WHEN 4 THEN 'protected' WHEN 5 THEN 'not approved' WHEN 6 THEN 'already' END AS reason,
sha256(CASE k % 8 WHEN 1 THEN 'other' WHEN 3 THEN NULL WHEN 0 THEN 'new ' || old WHEN 6 THEN 'new ' || old WHEN 7 THEN 'new ' || old ELSE old END) AS sha256 FROM s""")
def applied_patches(spark, d):
    """A tree of files of eight parts each, written by tasks; all their proposals applied in one batch; what then stands there."""
    folder = _local_folder(spark, "tree")
    k = F.col("k")
    files = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 8).alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    text = F.concat(F.array_join(F.transform("x", lambda r: F.concat(r["p_partkey"].cast("string"), F.lit(" "), r["p_name"])), "\n"), F.lit("\n"))
    path = F.when(k % 8 == 4, F.concat(F.lit(".env."), k.cast("string"))).otherwise(F.concat(F.lit("src/"), k.cast("string"), F.lit(".txt")))
    rows = files.select("k", text.alias("old"), path.alias("path"))
    rows = rows.withColumn("new", F.concat(F.lit("new "), "old"))

    def write(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is not None:
                    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
                    with open(f"{folder}/{name}", "w") as f:
                        f.write(content)
            yield batch

    stands = F.when(k % 8 == 1, "other").when(k % 8 == 6, F.col("new")).when(k % 8 != 3, F.col("old"))
    rows.select("path", stands.alias("content")).mapInArrow(write, "path string, content string").write.format("noop").mode("overwrite").save()
    proposals = rows.select(
        k.alias("proposal_id"), F.col("path").alias("file_path"), F.when(k % 8 == 5, "VALIDATED").otherwise("APPROVED").alias("state"),
        F.sha2("old", 256).alias("original_hash"), F.sha2("new", 256).alias("target_hash"), F.when(k % 8 == 2, F.lit("not that")).otherwise(F.col("new")).alias("content"),
    )
    told = patch_sink.apply(proposals, folder)
    left = discovery.files(spark, f"file://{folder}").select(F.col("path").alias("__p"), F.sha2("content", 256).alias("sha256"))
    return told.join(left, F.col("file_path") == F.col("__p"), "left").select("proposal_id", "file_path", "status", "reason", "sha256")


# --- verified copies -----------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 1 THEN 'lost' WHEN o_orderkey % 89 = 2 THEN 'repeated' ELSE 'changed' END AS verdict FROM orders WHERE o_orderkey % 97 = 1 OR o_orderkey % 89 = 2 OR o_orderkey % 83 = 3
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 101 = 4""")
def verified_copy(spark, d):
    """All orders copied with their checksums; a table that lost, doubled, changed and gained rows is held against the copy."""
    orders, o = table(spark, d, "orders"), F.col("o_orderkey")
    place = f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}"
    copies.copy(orders, place, ["o_orderkey"])
    if copies.verify(spark, place).limit(1).collect():
        raise RuntimeError("the copy is not whole")
    kept = orders.filter(o % 97 != 1)
    twice = kept.filter(o % 89 == 2)
    changed = kept.filter(o % 89 != 2).withColumn("o_totalprice", F.when(o % 83 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    damaged = changed.unionByName(twice).unionByName(twice).unionByName(orders.filter(o % 101 == 4).withColumn("o_orderkey", -o))
    return copies.differences(copies.copied(spark, place), damaged, ["o_orderkey"])


# --- sweeps --------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS a, (floor(epoch(ts)) + floor(value * 600))::BIGINT AS b FROM events),
w AS (SELECT *, max({'b': b, 'k': event_id}) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT user_id, event_id, m.k AS conflict FROM w WHERE m.b >= a""")
def first_conflicts(spark, d):
    at = F.unix_timestamp("ts")
    spans = table(spark, d, "events").select("user_id", "event_id", at.alias("a"), (at + F.floor(F.col("value") * 600)).cast("long").alias("b"))
    return sweeps.first_conflicts(spans, "user_id", "event_id", "a", "b")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS rank FROM lineitem")
def group_ranks(spark, d):
    """The rank of every line among those of its flag, of which there are three: no task holds a flag."""
    return sweeps.ranked(table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber"), ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rank")


@query("""WITH v AS (SELECT DISTINCT o_orderkey % 200 AS package, o_orderkey % 4 || '.' || o_custkey % 3 || '.' || o_orderkey % 5 || CASE WHEN o_orderkey % 6 = 0 THEN '-rc.' || o_custkey % 12 ELSE '' END AS version,
  [o_orderkey % 4, o_custkey % 3, o_orderkey % 5, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey % 12 ELSE 0 END]::BIGINT[] AS k FROM orders),
r AS (SELECT p_partkey, p_partkey % 200 AS package, CASE WHEN p_size % 5 > 0 THEN [p_size % 3, p_size % 2, 0, 1, 0]::BIGINT[] END AS lo, CASE WHEN p_size % 7 > 0 THEN [p_size % 3 + 1, p_size % 4, p_size % 5, p_size % 2, p_size % 2 - 1]::BIGINT[] END AS hi, p_size % 2 = 0 AS closed FROM part)
SELECT package::BIGINT AS package, version, p_partkey FROM v JOIN r USING (package) WHERE (lo IS NULL OR k >= lo) AND (hi IS NULL OR k < hi OR (closed AND k = hi))""")
def version_ranges(spark, d):
    """Every version of a package with the advisories of that package whose range holds it; versions are read once each, and compared as bytes."""
    o, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_size")
    dotted = lambda *parts: F.concat_ws(".", *[x.cast("string") for x in parts])
    plain = dotted(o % 4, c % 3, o % 5)
    used = table(spark, d, "orders").select((o % 200).alias("package"), F.when(o % 6 == 0, F.concat(plain, F.lit("-rc."), (c % 12).cast("string"))).otherwise(plain).alias("version")).distinct()
    low = F.when(s % 5 > 0, dotted(s % 3, s % 2, F.lit(0)))
    high = F.when(s % 7 > 0, F.concat(dotted(s % 3 + 1, s % 4, s % 5), F.when(s % 2 == 0, "-0").otherwise("")))
    known = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 200).alias("package"), low.alias("low"), high.alias("high"), (s % 2 == 0).alias("closed"))
    keys = used.select("version").unionByName(known.select(F.col("low").alias("version"))).unionByName(known.select(F.col("high").alias("version"))).filter("version IS NOT NULL").distinct()
    keys = settled(keys.select("version", vs.semver_key(F.col("version")).alias("key")), "keys")
    keys = settled(keys.select(F.col("version").alias("text"), vs.semver_bytes(F.col("key")).alias("at")), "texts")
    as_bytes = lambda df, name: df.join(keys.select(F.col("text").alias(f"__{name}"), F.col("at").alias(f"{name}_at")), F.col(name) == F.col(f"__{name}"), "left").drop(f"__{name}")
    points, ranges = as_bytes(used, "version"), as_bytes(as_bytes(known, "low"), "high")
    hits = sweeps.points_in_intervals(points, ranges, "package", "version_at", "p_partkey", "low_at", "high_at", "closed")
    named = points.select(F.col("package").alias("__package"), F.col("version_at").alias("__at"), "version")
    return hits.join(named, (F.col("package") == F.col("__package")) & (F.col("version_at") == F.col("__at"))).select("package", "version", "p_partkey")
