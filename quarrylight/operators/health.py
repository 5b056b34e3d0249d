"""Health scores and audit roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pillars and weights; deductions per severity.
WEIGHTS = {"maintainability": 0.25, "security": 0.25, "architecture": 0.20, "dependency": 0.20, "coverage": 0.10}


def _bounded(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def maintainability(complexity: Column, smells: Column, others: Column) -> Column:
    return _bounded(100.0 - complexity * 4.0 - smells * 2.0 - others * 3.0)


def security_deduction(severity: Column, confidence: Column) -> Column:
    return F.when(severity == "CRITICAL", 25.0).when((severity == "HIGH") & (confidence == "HIGH"), 18.0).when(severity == "HIGH", 12.0).when(severity == "MEDIUM", 6.0).otherwise(2.0)


def architecture(cycles: Column, violations: Column, unresolved: Column) -> Column:
    return _bounded(100.0 - F.least(F.lit(40.0), cycles * 10.0) - F.least(F.lit(50.0), violations * 15.0) - F.least(F.lit(20.0), unresolved * 2.0))


def dependency_deduction(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 25.0).when(severity == "HIGH", 15.0).when(severity == "MEDIUM", 8.0).otherwise(3.0)


def coverage(analysed: Column, sources: Column) -> Column:
    return F.when(sources > 0, F.least(analysed, sources) * 100.0 / sources)


def overall(pillars: dict[str, Column]) -> Column:
    """The mean of the available pillars by weight; null if maintainability and security are both missing."""
    mass = sum((F.when(p.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, p in pillars.items()), F.lit(0.0))
    total = sum((F.coalesce(p * WEIGHTS[k], F.lit(0.0)) for k, p in pillars.items()), F.lit(0.0))
    return F.when(pillars["maintainability"].isNotNull() | pillars["security"].isNotNull(), total / mass)


def status(score: Column, warning: float = 60.0) -> Column:
    return F.when(score.isNull(), "UNAVAILABLE").when(score >= 80, "HEALTHY").when(score >= warning, "WARNING").otherwise("CRITICAL")


def rollup(state: Column) -> list[Column]:
    """Counts of check states, and the worst that counts: FAILED, then WARNING, then ERROR."""
    states = ("PASSED", "FAILED", "WARNING", "SKIPPED", "UNSUPPORTED", "ERROR")
    n = {s: F.count_if(state == s) for s in states}
    worst = F.when(n["FAILED"] > 0, "FAILED").when(n["WARNING"] > 0, "WARNING").when(n["ERROR"] > 0, "ERROR").otherwise("PASSED")
    return [*[c.alias(s.lower()) for s, c in n.items()], worst.alias("overall")]


def latest_runs(runs: DataFrame, by: str, kind: str, status: str, started: str, columns: list[str]) -> DataFrame:
    """``by``, ``kind`` and ``columns`` of the latest completed run of each kind; those combine before the shuffle."""
    best = runs.filter(F.col(status) == "completed").groupBy(by, kind).agg(F.max_by(F.struct(*columns), F.struct(started, *columns)).alias("__run"))
    return best.select(by, kind, "__run.*")


def from_runs(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Every snapshot with its pillars, score, status and standing from the latest completed run of each kind.

    ``snapshots``: snapshot, source_files. ``runs``: snapshot, kind (analysis,
    dependency, architecture), status, started, complexity, smells, others,
    critical, high_sure, high, medium, low (of the kind's own findings), cycles,
    violations, unresolved, analysed. A pillar without such a run is null; scores have one decimal.
    """
    numbers = ["complexity", "smells", "others", "critical", "high_sure", "high", "medium", "low", "cycles", "violations", "unresolved", "analysed"]
    latest = latest_runs(runs, "snapshot", "kind", "status", "started", numbers)
    of = lambda kind: latest.filter(F.col("kind") == kind).select(F.col("snapshot").alias(f"__{kind}"), F.struct(*numbers).alias(f"run_{kind}"))
    joined = snapshots
    for kind in ("analysis", "dependency", "architecture"):
        joined = joined.join(of(kind), F.col("snapshot") == F.col(f"__{kind}"), "left")
    a, d, x = (lambda c: F.col(f"run_analysis.{c}")), (lambda c: F.col(f"run_dependency.{c}")), (lambda c: F.col(f"run_architecture.{c}"))
    have = lambda kind, score: F.when(F.col(f"__{kind}").isNotNull(), F.round(score, 1))
    sources = F.when(F.coalesce("source_files", F.lit(0)) > 0, F.col("source_files")).otherwise(1)
    pillars = {
        "maintainability": have("analysis", maintainability(a("complexity"), a("smells"), a("others"))),
        "security": have("analysis", _bounded(100.0 - a("critical") * 25.0 - a("high_sure") * 18.0 - a("high") * 12.0 - a("medium") * 6.0 - a("low") * 2.0)),
        "architecture": have("architecture", architecture(x("cycles"), x("violations"), x("unresolved"))),
        "dependency": have("dependency", _bounded(100.0 - d("critical") * 25.0 - (d("high") + d("high_sure")) * 15.0 - d("medium") * 8.0 - d("low") * 3.0)),
        "coverage": F.round(coverage(F.coalesce(a("analysed"), F.lit(0)), sources), 1),
    }
    scored = joined.withColumns(pillars)
    by_name = {k: F.col(k) for k in pillars}
    scored = scored.withColumn("score", F.round(overall(by_name), 1))
    missing = sum((F.col(k).isNull().cast("int") for k in pillars), F.lit(0))
    return scored.withColumns({
        "status": status(F.col("score")), "coverage_status": status(F.col("coverage"), 50.0),
        "standing": F.when(F.col("score").isNull(), "unavailable").when(missing > 0, "partial").otherwise("completed"),
    })


# How urgent an advice is.
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def recommendations(scored: DataFrame) -> DataFrame:
    """snapshot, turn (from 1), priority, dimension: what to do first, from the rows of ``from_runs``.

    The most urgent come first, equals in the order of the pillars.
    """
    a, d, x = (lambda c: F.coalesce(F.col(f"run_analysis.{c}"), F.lit(0))), (lambda c: F.coalesce(F.col(f"run_dependency.{c}"), F.lit(0))), (lambda c: F.coalesce(F.col(f"run_architecture.{c}"), F.lit(0)))
    advice = [
        (a("complexity") > 0, F.when(a("complexity") >= 3, "HIGH").otherwise("MEDIUM"), "maintainability"),
        (a("critical") > 0, F.lit("CRITICAL"), "application_security"), (a("high") + a("high_sure") > 0, F.lit("HIGH"), "application_security"),
        (x("violations") > 0, F.lit("HIGH"), "architectural_health"), (x("cycles") > 0, F.lit("MEDIUM"), "architectural_health"),
        (d("critical") > 0, F.lit("CRITICAL"), "dependency_risk"), (d("high") + d("high_sure") > 0, F.lit("HIGH"), "dependency_risk"),
    ]
    rank = lambda p: F.array_position(F.array(*[F.lit(x) for x in PRIORITIES]), p)
    made = F.array(*[F.when(when, F.struct(rank(p).alias("rank"), F.lit(i).alias("emitted"), p.alias("priority"), F.lit(name).alias("dimension"))) for i, (when, p, name) in enumerate(advice)])
    listed = scored.select("snapshot", F.posexplode(F.array_sort(F.filter(made, lambda m: m.isNotNull()))).alias("i", "r"))
    return listed.select("snapshot", (F.col("i") + 1).alias("turn"), "r.priority", "r.dimension")
