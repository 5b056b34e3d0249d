"""The audit of a snapshot: six checks over its latest runs, how they add up, and a report to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.operators import health

#: More functions than this that are too long or too complex fail the check.
MOST_COMPLEX = 10
#: Findings that a report shows of each snapshot.
SHOWN = 50

# The checks, in their order.
CHECKS = (
    ("AUDIT-INGEST-001", "INGESTION"), ("AUDIT-STATIC-001", "STATIC_ANALYSIS"), ("AUDIT-SCA-001", "DEPENDENCY_SCA"),
    ("AUDIT-APPSEC-001", "APPSEC_INTELLIGENCE"), ("AUDIT-ARCH-001", "ARCHITECTURE_GOVERNANCE"), ("AUDIT-REMEDIATION-001", "REMEDIATION_VALIDATION"),
)


def _latest(runs: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Per snapshot the latest run of a kind, whatever became of it."""
    best = runs.filter(F.col("kind") == kind).groupBy("snapshot").agg(F.max_by(F.struct("run", "status", *columns), F.struct("started", "run")).alias("r"))
    return best.select(F.col("snapshot").alias(f"__{kind}_of"), F.col("r").alias(kind))


def checks(snapshots: DataFrame, runs: DataFrame, findings: DataFrame, vulnerabilities: DataFrame, proposals: DataFrame) -> DataFrame:
    """snapshot, check_id, category, state, count of all six checks of every snapshot.

    ``snapshots``: snapshot, status, files. ``runs``: snapshot, run, kind, status,
    started, cycles, violations. ``findings``: run, rule_id, severity.
    ``vulnerabilities``: run, severity. ``proposals``: snapshot, status. Only the latest
    run of a kind counts; a check whose run did not complete is skipped.
    """
    severe = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    complex_ = F.col("rule_id").contains("COMPLEXITY") | F.col("rule_id").contains("FUNCTION")
    secure = F.col("rule_id").contains("SEC")
    found = findings.groupBy(F.col("run").alias("__run")).agg(
        F.count_if(complex_).alias("complex"), F.count_if(secure).alias("secure"), F.count_if(secure & F.col("severity").isin("CRITICAL", "HIGH")).alias("severe")
    )
    known = vulnerabilities.groupBy(F.col("run").alias("__dep")).agg(F.count(F.lit(1)).alias("known"), severe.alias("known_severe"))
    made = proposals.groupBy(F.col("snapshot").alias("__p")).agg(F.count(F.lit(1)).alias("proposals"))
    joined = snapshots.join(_latest(runs, "analysis", []), F.col("snapshot") == F.col("__analysis_of"), "left")
    joined = joined.join(_latest(runs, "dependency", []), F.col("snapshot") == F.col("__dependency_of"), "left")
    joined = joined.join(_latest(runs, "architecture", ["cycles", "violations"]), F.col("snapshot") == F.col("__architecture_of"), "left")
    joined = joined.join(found, F.col("analysis.run") == F.col("__run"), "left").join(known, F.col("dependency.run") == F.col("__dep"), "left").join(made, F.col("snapshot") == F.col("__p"), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    done = lambda kind: F.coalesce(F.col(f"{kind}.status") == "completed", F.lit(False))
    ran = lambda kind, state: F.when(done(kind), state).otherwise("SKIPPED")
    graded = lambda failed, warned: F.when(failed, "FAILED").when(warned, "WARNING").otherwise("PASSED")
    states = [
        (F.when((F.col("status") == "completed") & (n("files") > 0), "PASSED").otherwise("WARNING"), n("files")),
        (ran("analysis", graded(n("complex") > MOST_COMPLEX, n("complex") > 0)), n("complex")),
        (ran("dependency", graded(n("known_severe") > 0, n("known") > 0)), n("known")),
        (ran("analysis", graded(n("severe") > 0, n("secure") > 0)), n("secure")),
        (ran("architecture", graded(n("architecture.violations") > 0, n("architecture.cycles") > 0)), n("architecture.violations")),
        (F.when(n("proposals") > 0, "PASSED").otherwise("WARNING"), n("proposals")),
    ]
    six = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(c).alias("check_id"), F.lit(g).alias("category"), s.alias("state"), x.cast("long").alias("count")) for i, ((c, g), (s, x)) in enumerate(zip(CHECKS, states, strict=True))])
    return joined.select("snapshot", F.explode(six).alias("c")).select("snapshot", "c.check_id", "c.category", "c.state", "c.count")


def outcome(checked: DataFrame) -> DataFrame:
    """snapshot, how many checks are in each state, and the overall one."""
    return checked.groupBy("snapshot").agg(*health.rollup(F.col("state")))


def report(checked: DataFrame, findings: DataFrame, shown: int = SHOWN) -> DataFrame:
    """snapshot and report: Markdown with the checks and the first ``shown`` findings of each snapshot.

    ``findings``: snapshot, rule_id, severity, path, line, end_line, evidence. Only the
    first are ranked and gathered, so a snapshot with many is no heavy row; how many more there are is counted.
    """
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    ticks = lambda c: F.concat(F.lit("`"), cell(c), F.lit("`"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    state: Column = F.concat(F.lit("**"), "state", F.lit("**"))
    head = outcome(checked).withColumnRenamed("snapshot", "__s")
    listed = checked.groupBy("snapshot").agg(F.array_sort(F.collect_list(F.struct("check_id", row(ticks(F.col("check_id")), F.col("category"), state, F.col("count").cast("string")).alias("row")))).alias("checks"))
    order = ["path", "line", "rule_id", "evidence"]
    first = findings.withColumn("__r", F.row_number().over(W.partitionBy("snapshot").orderBy(*order))).filter(F.col("__r") <= shown)
    lines = F.concat(F.coalesce(F.col("line"), F.lit(1)).cast("string"), F.lit("-"), F.coalesce(F.col("end_line"), F.col("line"), F.lit(1)).cast("string"))
    rows = first.groupBy(F.col("snapshot").alias("__f")).agg(F.array_sort(F.collect_list(F.struct("__r", row(ticks(F.col("rule_id")), F.col("severity"), ticks(F.col("path")), lines, cell(F.col("evidence"))).alias("row")))).alias("rows"))
    total = findings.groupBy(F.col("snapshot").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    joined = listed.join(head, F.col("snapshot") == F.col("__s")).join(rows, F.col("snapshot") == F.col("__f"), "left").join(total, F.col("snapshot") == F.col("__t"), "left")
    found = F.coalesce("__n", F.lit(0))
    more = F.when(found > shown, F.concat(F.lit("\n\n*"), (found - shown).cast("string"), F.lit(" more findings*"))).otherwise("")
    table = F.concat(F.lit("\n\n## Findings\n| Rule | Severity | File | Lines | Evidence |\n| :- | :- | :- | :- | :- |\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), more)
    text = F.concat(
        F.lit("# Audit of "), F.col("snapshot").cast("string"), F.lit("\n- Outcome: **"), "overall", F.lit("**\n- Findings: "), found.cast("string"),
        F.lit("\n\n## Checks\n| Check | Category | State | Count |\n| :- | :- | :- | :- |\n"), F.array_join(F.transform("checks", lambda c: c["row"]), "\n"), F.coalesce(F.when(found > 0, table), F.lit("")),
    )
    return joined.select("snapshot", text.alias("report"))
