"""Advisories from JSON: read, judged row by row, and put in place of the last set at once."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import moment, number, package_name
from quarrylight.sources import journal

EVENT = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
RANGE = f"struct<spec:string,events:array<{EVENT}>>"
RAW = f"advisory_id string, ecosystem string, package_name string, summary string, description string, severity string, severity_source string, cvss_score string, cve_ids array<string>, affected_ranges_json array<{RANGE}>, fixed_versions_json array<string>, source_url string, published_at string, modified_at string"
FILE = f"dataset_version string, source_name string, advisories array<struct<{', '.join(f'{c.split(maxsplit=1)[0]}:{c.split(maxsplit=1)[1]}' for c in RAW.split(', '))}>>"
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The advisories of JSON files (an object with a list) as rows of text, with ``dataset_version``; ``turn`` is the place in the list."""
    return spark.read.schema(FILE).json(path, multiLine=True).select("dataset_version", F.posexplode("advisories").alias("turn", "a")).select("dataset_version", "turn", "a.*")


def judged(raw: DataFrame) -> DataFrame:
    """Every row with ``problem``: missing for one that lacks a needed field, repeated for a later one of the same id, ecosystem and package; null if it is taken.

    Names are made canonical, unknown severities UNKNOWN, dates and scores that
    cannot be read null. The first by ``turn`` stands.
    """
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    complete = full("advisory_id") & full("ecosystem") & full("package_name") & full("summary") & F.col("affected_ranges_json").isNotNull()
    eco, said = F.lower(F.trim("ecosystem")), F.upper(F.trim("severity"))
    rows = raw.select(
        "turn", F.trim("advisory_id").alias("advisory_id"), eco.alias("ecosystem"), package_name(F.col("package_name"), F.trim("ecosystem")).alias("package"), F.substring("summary", 1, 1024).alias("summary"),
        F.when(said.isin(*SEVERITIES), said).otherwise("UNKNOWN").alias("severity"), number(F.col("cvss_score")).alias("cvss_score"), F.coalesce("cve_ids", F.array().cast("array<string>")).alias("cve_ids"),
        F.col("affected_ranges_json").alias("ranges"), F.coalesce("fixed_versions_json", F.array().cast("array<string>")).alias("fixed_versions"), moment(F.col("published_at")).alias("published_at"), moment(F.col("modified_at")).alias("modified_at"),
        complete.alias("__complete"),
    )
    same = ["advisory_id", "ecosystem", "package"]
    first = rows.filter("__complete").groupBy(*[F.col(c).alias(f"__{c}") for c in same]).agg(F.min("turn").alias("__first"))
    match = [rows[c] == first[f"__{c}"] for c in same]
    joined = rows.join(first, match, "left")
    problem = F.when(~F.col("__complete"), "missing").when(F.col("turn") != F.col("__first"), "repeated")
    return joined.select(*[c for c in rows.columns if c != "__complete"], problem.alias("problem"))


def accepted(told: DataFrame) -> DataFrame:
    return told.filter("problem IS NULL").drop("problem", "turn")


def swap(advisories: DataFrame, base: str, version: str, expected: int | None = None) -> DataFrame:
    """Stages ``advisories`` as a set of its own under ``base`` and makes it the current one; the rows of ``status``.

    The set is complete before an entry of a numbered log names it, and that entry is the last
    thing written, so readers see the old set or the new. Two swaps at once get two numbers, and the higher
    one is in place whatever their clocks say; with ``expected``, the number of the set that the new one was made from, the later of the two fails instead.
    What failed on the way leaves the old set in place; old sets stay for those who still read them.
    """
    if not version.strip():
        raise ValueError("a set of advisories needs a version")
    spark = advisories.sparkSession
    path = f"{base}/sets/{uuid.uuid4().hex}"
    advisories.write.parquet(path)
    records = spark.read.parquet(path).count()
    since = datetime.now(timezone.utc).isoformat()
    journal.append(spark, f"{base}/log", {"version": version.strip(), "path": path, "records": records, "since": since}, expected)
    return status(spark, base)


def status(spark: SparkSession, base: str) -> DataFrame:
    """number, version, path, records, since, state of all sets that were ever in place; the last number is active, those before it superseded."""
    log = journal.entries(spark, f"{base}/log", "number long, version string, path string, records long, since timestamp")
    last = log.agg(F.max("number").alias("__last"))
    state = F.when(F.col("number") == F.col("__last"), "active").otherwise("superseded")
    return log.join(F.broadcast(last)).select("number", "version", "path", "records", "since", state.alias("state"))  # one row


def current(spark: SparkSession, base: str) -> DataFrame:
    """The advisories of the active set."""
    path = status(spark, base).filter("state = 'active'").first()["path"]
    return spark.read.parquet(path)
