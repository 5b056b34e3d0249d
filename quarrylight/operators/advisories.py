"""Which packages an advisory affects: equal names by join, then the ranges of their ecosystem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import versions as vs
from quarrylight.sources.shared import settled

EVENTS = "array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>"
RANGES = f"array<struct<spec:string,events:{EVENTS}>>"

# Names of ecosystems by the version rules that they follow.
PYTHON = ("pypi", "python")
SEMANTIC = ("npm", "javascript", "typescript")


def ecosystem(name: Column) -> Column:
    return F.lower(F.trim(name))


def _events(events: Column, key: Callable[[Column], Column]) -> Column:
    """Range events as (kind, key), in order; the version 0 is where every range starts."""
    kinds = ("introduced", "fixed", "last_affected", "limit")

    def one(e: Column) -> Column:
        kind = F.coalesce(*[F.when(e[k].isNotNull(), F.lit(k)) for k in kinds])
        raw = F.trim(F.coalesce(*[e[k] for k in kinds]))
        return F.struct(kind.alias("kind"), key(F.when((kind == "introduced") & (raw == "0"), F.lit("0.0.0")).otherwise(raw)).alias("key"))

    return F.transform(F.filter(events, lambda e: F.coalesce(*[e[k] for k in kinds]).isNotNull()), one)


def _fixes(texts: Column, key: Callable[[Column], Column]) -> Column:
    """Fixed versions that can be read, as (key, text)."""
    read = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.struct(key(t).alias("key"), F.trim(t).alias("text")))
    return F.filter(read, lambda f: f["key"].isNotNull())


def _prepared(advisories: DataFrame, key: Callable[[Column], Column], parse: Callable[[Column], Column]) -> DataFrame:
    """Each advisory with its ranges and fixes read once, however many versions meet it."""
    ranges = F.transform(F.coalesce("ranges", F.array().cast(RANGES)), lambda r: F.struct(r["spec"].alias("spec"), parse(r["spec"]).alias("parsed"), _events(r["events"], key).alias("events")))
    noted = F.flatten(F.transform(F.coalesce("ranges", F.array().cast(RANGES)), lambda r: F.transform(F.coalesce(r["events"], F.array().cast(EVENTS)), lambda e: e["fixed"])))
    listed, told = _fixes(F.col("fixed_versions"), key), _fixes(F.filter(noted, lambda t: t.isNotNull()), key)
    return advisories.select(
        F.col("advisory_id"), ecosystem(F.col("ecosystem")).alias("of"), F.col("package").alias("named"), ranges.alias("read"), listed.alias("fixes"), F.when(F.size(listed) > 0, listed).otherwise(told).alias("remedies"),
    )


def _judged(used: DataFrame, advisories: DataFrame, key: Callable[[Column], Column], kind: str, parse: Callable[[Column], Column], meets: Callable[[Column, Column], Column]) -> DataFrame:
    """Ranges are written down once they are read, so that Spark does not read them again for every pair."""
    asked = used.withColumn("key", key(F.col("version")))
    met = asked.join(settled(_prepared(advisories, key, parse), "advisories"), (F.col("eco") == F.col("of")) & (F.col("package") == F.col("named")))
    at = F.col("key")
    fixed = F.exists("fixes", lambda f: f["key"] == at)
    hit = F.exists("read", lambda r: F.coalesce(meets(at, r), F.lit(False)) | F.coalesce((F.size(r["events"]) > 0) & vs.in_events(at, r["events"], kind), F.lit(False)))
    matched = at.isNotNull() & ~fixed & hit
    remedy = F.when(matched & (F.size("remedies") > 0), vs.remediation(at, F.col("remedies")))
    return met.select("ecosystem", "package", "version", "advisory_id", matched.alias("matched"), at.isNull().alias("indeterminate"), remedy.alias("remediation"))


def satisfied(rows: DataFrame, version: str, text: str, python: bool = False, name: str = "matched") -> DataFrame:
    """Adds whether each row's version lies in its range, by npm's or Python's rules; null if either cannot be read.

    Different versions and different ranges are read once each and written down; different pairs of them are judged once each, and rows
    take over what their pair got. Null versions and ranges match nothing known: null.
    """
    key = vs.pep440_key if python else vs.semver_key
    parse = vs.pep440_specifiers if python else vs.npm_branches
    keys = settled(rows.select(F.col(version).alias("__v")).distinct().filter("__v IS NOT NULL").select("__v", key(F.col("__v")).alias("__key")), "keys")
    read = settled(rows.select(F.col(text).alias("__t")).distinct().filter("__t IS NOT NULL").select("__t", parse(F.col("__t")).alias("__parsed")), "ranges")
    pairs = rows.select(F.col(version).alias("__pv"), F.col(text).alias("__pt")).distinct()
    met = pairs.join(keys, F.col("__pv") == F.col("__v")).join(read, F.col("__pt") == F.col("__t"))
    judged = vs.pep440_meets(F.col("__pv"), F.col("__key"), F.col("__parsed")) if python else vs.npm_meets(F.col("__key"), F.col("__pt"), F.col("__parsed"))
    told = settled(met.select("__pv", "__pt", judged.alias(name)), "judged")
    return rows.join(told, (F.col(version) == F.col("__pv")) & (F.col(text) == F.col("__pt")), "left").select(*rows.columns, name)


def affected(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """ecosystem, package, version, advisory_id, matched, indeterminate, remediation for every version that meets an advisory by name.

    ``dependencies``: ecosystem, package, version; each different row is judged once,
    so a package that a third of all projects use is one row per version.
    ``advisories``: advisory_id, ecosystem, package, ranges (``RANGES``), fixed_versions array<string>.

    A version that is a listed fix is not affected. Else it is if any range holds: a
    text by the rules of its ecosystem, or events folded in order. The remedy is the
    least fix above the version, else the greatest; without listed fixes, those of
    the events count. A version that is null or cannot be read, and any ecosystem without
    version rules, is indeterminate and never matched. Null names meet nothing.
    """
    used = dependencies.select("ecosystem", "package", "version").distinct().withColumn("eco", ecosystem(F.col("ecosystem")))
    python = _judged(used.filter(F.col("eco").isin(*PYTHON)), advisories, vs.pep440_key, vs.PEP440_KEY, vs.pep440_specifiers, lambda k, r: vs.pep440_meets(F.col("version"), k, r["parsed"]))
    semantic = _judged(used.filter(F.col("eco").isin(*SEMANTIC)), advisories, vs.semver_key, vs.KEY, vs.npm_branches, lambda k, r: vs.npm_meets(k, r["spec"], r["parsed"]))
    others = used.filter(~F.col("eco").isin(*PYTHON, *SEMANTIC))
    named = advisories.select("advisory_id", ecosystem(F.col("ecosystem")).alias("of"), F.col("package").alias("named"))
    unknown = others.join(named, (F.col("eco") == F.col("of")) & (F.col("package") == F.col("named")))
    unknown = unknown.select("ecosystem", "package", "version", "advisory_id", F.lit(False).alias("matched"), F.lit(True).alias("indeterminate"), F.lit(None).cast("string").alias("remediation"))
    return python.unionByName(semantic).unionByName(unknown)
