"""Queries on module graphs, health, audits, runs and searches: what a repository's standing is made of."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions.text import words
from quarrylight.operators import audit, graph, health, metrics, relational, retrieval, sweeps
from quarrylight.plans.catalogue import _EDGES, _edges
from quarrylight.plans.registry import ORACLES, query, table, values
from quarrylight.sources import policies
from quarrylight.sources.shared import shared_dir
from quarrylight.streaming import tasks

# --- module graphs -------------------------------------------------------------------------------

_MODULES = _EDGES + """, c AS (SELECT s_nationkey AS k, count(*) AS classes, count(*) FILTER (s_suppkey % 3 = 0) AS abstract_classes FROM supplier GROUP BY 1),
o AS (SELECT source AS m, count(*) AS ce FROM g WHERE source <> target GROUP BY 1), i AS (SELECT target AS m, count(*) AS ca FROM g WHERE source <> target GROUP BY 1),
b AS (SELECT n_name AS module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 4) END AS instability,
  CASE WHEN classes > 0 THEN round(abstract_classes / classes, 4) END AS abstractness FROM nation LEFT JOIN o ON n_nationkey = o.m LEFT JOIN i ON n_nationkey = i.m LEFT JOIN c ON n_nationkey = k)
"""


def _named(spark, d) -> DataFrame:
    """The graph of nations as modules: source, target, specifier, line, kind; some edges lead to packages or nowhere."""
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    both = _edges(spark, d).join(names.select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("s")), "source").join(names.select(F.col("n_nationkey").alias("target"), F.col("n_name").alias("t")), "target")
    kind = F.when(F.col("target") % 11 == 5, "external").when(F.col("target") % 11 == 7, "unresolved").otherwise("internal")
    return both.select(F.col("s").alias("source"), F.col("t").alias("target"), F.concat(F.lit("to "), "t").alias("specifier"), F.col("target").cast("int").alias("line"), kind.alias("kind"))


_NAMED = _EDGES + """, x AS (SELECT a.n_name AS source, b.n_name AS target, 'to ' || b.n_name AS specifier, target::INT AS line, CASE WHEN target % 11 = 5 THEN 'external' WHEN target % 11 = 7 THEN 'unresolved' ELSE 'internal' END AS kind
  FROM g JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey)
"""
_CYCLES = """, w AS (SELECT source AS a, target AS b FROM x WHERE kind = 'internal' UNION SELECT w.a, x.target FROM w JOIN x ON w.b = x.source AND x.kind = 'internal'),
y AS (SELECT p.a AS node, min(p.b) AS component FROM w p JOIN w q ON p.a = q.b AND p.b = q.a GROUP BY 1)
"""


def _metrics(spark, d) -> DataFrame:
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("module"))
    classes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("s_suppkey") % 3 == 0).alias("abstract_classes"))
    modules = names.join(classes, "n_nationkey", "left").select("module", F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("abstract_classes", F.lit(0)).alias("abstract_classes"))
    of = names.select("n_nationkey", "module")
    edges = _edges(spark, d).join(of.select(F.col("n_nationkey").alias("source"), F.col("module").alias("s")), "source").join(of.select(F.col("n_nationkey").alias("target"), F.col("module").alias("t")), "target")
    return graph.module_metrics(modules, edges.select(F.col("s").alias("source"), F.col("t").alias("target")))


@query(_MODULES + "SELECT *, round(abs(abstractness + instability - 1), 4) AS distance FROM b")
def module_metrics(spark, d):
    return _metrics(spark, d)


@query(_MODULES + "SELECT module, ca, ce, row_number() OVER (ORDER BY instability DESC NULLS LAST, module)::INT AS turn FROM b WHERE contains(lower(module), '_1') ORDER BY turn")
def module_listing(spark, d):
    """Modules by a part of their name, least stable first."""
    listed = graph.module_list(_metrics(spark, d), " _1", "instability")
    turns = sweeps.ranked(listed.withColumn("down", F.coalesce(-F.col("instability"), F.lit(1.0))), [], ["down", "module"])
    return turns.select("module", "ca", "ce", (F.col("rank") + 1).cast("int").alias("turn")).orderBy("turn")


@query(_MODULES + "SELECT 'ca' AS side, module, ca AS n FROM (SELECT * FROM b ORDER BY ca DESC, module LIMIT 10) WHERE ca > 0 UNION ALL SELECT 'ce', module, ce FROM (SELECT * FROM b ORDER BY ce DESC, module LIMIT 10) WHERE ce > 0")
def most_coupled(spark, d):
    found = _metrics(spark, d)
    return graph.most_coupled(found, "ca").select(F.lit("ca").alias("side"), "module", F.col("ca").alias("n")).unionByName(graph.most_coupled(found, "ce").select(F.lit("ce").alias("side"), "module", F.col("ce").alias("n")))


@query(_NAMED.replace("WITH e", "WITH RECURSIVE e") + _CYCLES + """, s AS (SELECT n_name AS m, (SELECT count(DISTINCT target) FROM x WHERE source = n_name AND target <> n_name AND kind = 'internal') AS ce, (SELECT count(DISTINCT source) FROM x WHERE target = n_name AND source <> n_name AND kind = 'internal') AS ca FROM nation)
SELECT (SELECT count(*) FROM nation) AS modules, (SELECT count(*) FROM s WHERE ca = 0 AND ce = 0) AS isolated, (SELECT count(*) FROM x WHERE kind = 'internal') AS internal, (SELECT count(*) FROM x WHERE kind = 'external') AS external, (SELECT count(*) FROM x WHERE kind = 'unresolved') AS unresolved, (SELECT count(DISTINCT component) FROM y) AS cycles""")
def graph_summary(spark, d):
    edges = _named(spark, d)
    inside = edges.filter("kind = 'internal'")
    return graph.graph_summary(graph.coupling(table(spark, d, "nation").select(F.col("n_name").alias("module")), inside), edges, graph.strong_components(inside))


POLICY = json.dumps({
    "layers": [{"name": "units", "patterns": ["NATION_?"]}, {"name": "teens", "patterns": ["*_1*"]}, {"name": "rest", "patterns": ["*"]}],
    "rules": [{"id": "R1", "from_layer": "units", "forbidden_to_layer": "teens"}, {"id": "R2", "from_layer": "teens", "allowed_to_layers": ["units"], "severity": "low"}],
    "forbidden_dependencies": [{"rule_id": "F1", "from_pattern": "*_2", "to_pattern": "*"}, {"from_pattern": "NATION_1?", "to_pattern": "NATION_1[0-5]"}],
    "disallow_cycles": True,
})
_LAYER = "CASE WHEN regexp_full_match({0}, 'NATION_.') THEN 'units' WHEN contains({0}, '_1') THEN 'teens' ELSE 'rest' END"
_VIOLATIONS = _NAMED.replace("WITH e", "WITH RECURSIVE e") + _CYCLES + f""", l AS (SELECT *, {_LAYER.format('source')} AS fl, {_LAYER.format('target')} AS tl FROM x),
v AS (SELECT 'R1' AS rule_id, 'HIGH' AS severity, source, target, line, fl || ' -> ' || tl AS boundary, 'layer_forbidden' AS kind FROM l WHERE kind = 'internal' AND fl = 'units' AND tl = 'teens'
 UNION ALL SELECT 'R2', 'LOW', source, target, line, fl || ' -> ' || tl, 'allowed_layers_mismatch' FROM l WHERE kind = 'internal' AND fl = 'teens' AND tl NOT IN ('teens', 'units')
 UNION ALL SELECT 'F1', 'CRITICAL', source, target, line, '*_2 -> *', 'forbidden_pattern' FROM l WHERE kind <> 'unresolved' AND regexp_full_match(source, '.*_2')
 UNION ALL SELECT 'FORBIDDEN-2', 'CRITICAL', source, target, line, 'NATION_1? -> NATION_1[0-5]', 'forbidden_pattern' FROM l WHERE kind <> 'unresolved' AND regexp_full_match(source, 'NATION_1.') AND regexp_full_match(target, 'NATION_1[0-5]')
 UNION ALL SELECT 'ARCH-CYCLE-DETECTED', 'HIGH', component, coalesce(min(node) FILTER (node <> component), component), 1, 'cyclic_dependency', 'cycle_disallowed' FROM y GROUP BY component)
"""


@query(_VIOLATIONS + "SELECT DISTINCT sha256(rule_id || ':' || source || ':' || target || ':' || boundary) AS fingerprint, rule_id, severity, source, target, line::INT AS line, boundary, kind FROM v")
def governance(spark, d):
    """All that a policy forbids in one result: layers, patterns and cycles."""
    edges = _named(spark, d)
    modules = table(spark, d, "nation").select(F.col("n_name").alias("module"))
    found = graph.governance(modules, edges, policies.parsed(POLICY), graph.strong_components(edges.filter("kind = 'internal'")))
    return found.select("fingerprint", "rule_id", "severity", "source", "target", "line", "boundary", "kind")


@query(_VIOLATIONS + """SELECT 'incoming' AS part, source AS other, line FROM x WHERE target = 'NATION_12' AND kind = 'internal' UNION ALL SELECT 'outgoing', target, line FROM x WHERE source = 'NATION_12' AND kind = 'internal'
UNION ALL SELECT kind, target, line FROM x WHERE source = 'NATION_12' AND kind <> 'internal' UNION ALL SELECT 'cycle', node, NULL FROM y WHERE component = (SELECT component FROM y WHERE node = 'NATION_12')
UNION ALL SELECT DISTINCT 'violation', rule_id, line::INT FROM (SELECT DISTINCT rule_id, source, target, line, boundary FROM v) WHERE source = 'NATION_12' OR target = 'NATION_12'""")
def module_detail(spark, d):
    edges = _named(spark, d)
    parts = graph.strong_components(edges.filter("kind = 'internal'"))
    modules = table(spark, d, "nation").select(F.col("n_name").alias("module"))
    broken = graph.governance(modules, edges, policies.parsed(POLICY), parts)
    return graph.module_detail("NATION_12", edges, parts, broken).distinct()


# --- health and audit ----------------------------------------------------------------------------

_RUNS = """
WITH r AS (SELECT user_id AS snapshot, event_id AS run, ts AS started, CASE event_type WHEN 'purchase' THEN 'dependency' WHEN 'signup' THEN 'architecture' ELSE 'analysis' END AS kind,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 9 = 0 THEN 'running' ELSE 'completed' END AS status, event_id AS v FROM events),
s AS (SELECT DISTINCT user_id AS snapshot, user_id % 7 AS source_files FROM events UNION ALL SELECT -1, 3)
"""


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    e, v = F.col("event_type"), F.col("event_id")
    kind = F.when(e == "purchase", "dependency").when(e == "signup", "architecture").otherwise("analysis")
    status = F.when(e == "error", "failed").when(v % 9 == 0, "running").otherwise("completed")
    number = lambda name, n: (v % n).cast("int").alias(name)
    numbers = [number("complexity", 5), number("smells", 4), number("others", 3), number("critical", 2), number("high_sure", 3), number("high", 2), number("medium", 4), number("low", 6), number("cycles", 3), number("violations", 4), number("unresolved", 12), number("analysed", 8)]
    rows = table(spark, d, "events")
    runs = rows.select(F.col("user_id").alias("snapshot"), v.alias("run"), F.col("ts").alias("started"), kind.alias("kind"), status.alias("status"), *numbers)
    snapshots = rows.select(F.col("user_id").alias("snapshot"), (F.col("user_id") % 7).cast("int").alias("source_files")).distinct()
    return snapshots.unionByName(spark.createDataFrame([(-1, 3)], "snapshot long, source_files int")), runs


_HEALTH = _RUNS + """, b AS (SELECT snapshot, kind, arg_max(v, (started, v % 5, v % 4, v % 3, v % 2, v % 3, v % 2, v % 4, v % 6, v % 3, v % 4, v % 12, v % 8)) AS v FROM r WHERE status = 'completed' GROUP BY 1, 2),
j AS (SELECT s.snapshot, source_files, a.v AS a, d.v AS d, x.v AS x FROM s LEFT JOIN b a ON a.snapshot = s.snapshot AND a.kind = 'analysis' LEFT JOIN b d ON d.snapshot = s.snapshot AND d.kind = 'dependency' LEFT JOIN b x ON x.snapshot = s.snapshot AND x.kind = 'architecture'),
p AS (SELECT *, round(greatest(0, 100.0 - 4 * (a % 5) - 2 * (a % 4) - 3 * (a % 3)), 1)::DOUBLE AS maintainability, CASE WHEN a IS NOT NULL THEN round(greatest(0, 100.0 - 25 * (a % 2) - 18 * (a % 3) - 12 * (a % 2) - 6 * (a % 4) - 2 * (a % 6)), 1)::DOUBLE END AS security,
  CASE WHEN x IS NOT NULL THEN round(greatest(0, 100.0 - least(40, 10 * (x % 3)) - least(50, 15 * (x % 4)) - least(20, 2 * (x % 12))), 1)::DOUBLE END AS architecture,
  CASE WHEN d IS NOT NULL THEN round(greatest(0, 100.0 - 25 * (d % 2) - 15 * (d % 3 + d % 2) - 8 * (d % 4) - 3 * (d % 6)), 1)::DOUBLE END AS dependency,
  round(least(coalesce(a % 8, 0), CASE WHEN source_files > 0 THEN source_files ELSE 1 END) * 100.0::DOUBLE / CASE WHEN source_files > 0 THEN source_files ELSE 1 END, 1) AS coverage FROM j),
q AS (SELECT *, CASE WHEN a IS NOT NULL THEN round((maintainability * 0.25::DOUBLE + security * 0.25::DOUBLE + coalesce(architecture * 0.2::DOUBLE, 0) + coalesce(dependency * 0.2::DOUBLE, 0) + coverage * 0.1::DOUBLE) / (0.25::DOUBLE + 0.25::DOUBLE + CASE WHEN architecture IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN dependency IS NULL THEN 0 ELSE 0.2::DOUBLE END + 0.1::DOUBLE), 1) END AS score FROM
  (SELECT * REPLACE (CASE WHEN a IS NOT NULL THEN maintainability END AS maintainability) FROM p))
"""


@query(_HEALTH + """SELECT snapshot, maintainability, security, architecture, dependency, coverage, score, CASE WHEN score IS NULL THEN 'UNAVAILABLE' WHEN score >= 80 THEN 'HEALTHY' WHEN score >= 60 THEN 'WARNING' ELSE 'CRITICAL' END AS status,
CASE WHEN coverage >= 80 THEN 'HEALTHY' WHEN coverage >= 50 THEN 'WARNING' ELSE 'CRITICAL' END AS coverage_status, CASE WHEN score IS NULL THEN 'unavailable' WHEN architecture IS NULL OR dependency IS NULL THEN 'partial' ELSE 'completed' END AS standing FROM q""")
def health_from_runs(spark, d):
    """All five pillars of every snapshot from the latest completed run of each kind."""
    scored = health.from_runs(*_runs(spark, d))
    return scored.select("snapshot", "maintainability", "security", "architecture", "dependency", "coverage", "score", "status", "coverage_status", "standing")


@query(_HEALTH + """, k AS (SELECT snapshot, unnest([
 CASE WHEN a % 5 > 0 THEN {'r': CASE WHEN a % 5 >= 3 THEN 2 ELSE 3 END, 'e': 0, 'd': 'maintainability'} END, CASE WHEN a % 2 > 0 THEN {'r': 1, 'e': 1, 'd': 'application_security'} END, CASE WHEN a % 2 + a % 3 > 0 THEN {'r': 2, 'e': 2, 'd': 'application_security'} END,
 CASE WHEN x % 4 > 0 THEN {'r': 2, 'e': 3, 'd': 'architectural_health'} END, CASE WHEN x % 3 > 0 THEN {'r': 3, 'e': 4, 'd': 'architectural_health'} END, CASE WHEN d % 2 > 0 THEN {'r': 1, 'e': 5, 'd': 'dependency_risk'} END, CASE WHEN d % 3 + d % 2 > 0 THEN {'r': 2, 'e': 6, 'd': 'dependency_risk'} END]) AS z FROM j)
SELECT snapshot, row_number() OVER (PARTITION BY snapshot ORDER BY z.r, z.e)::INT AS turn, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][z.r] AS priority, z.d AS dimension FROM k WHERE z IS NOT NULL""")
def recommendations(spark, d):
    return health.recommendations(health.from_runs(*_runs(spark, d)))


_LEVELS = "CASE event_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END"


@query(f"""SELECT user_id, sum(CASE WHEN s = 'CRITICAL' THEN 25 WHEN s = 'HIGH' AND event_id % 2 = 0 THEN 18 WHEN s = 'HIGH' THEN 12 WHEN s = 'MEDIUM' THEN 6 ELSE 2 END)::DOUBLE AS security, sum(CASE WHEN s = 'CRITICAL' THEN 25 WHEN s = 'HIGH' THEN 15 WHEN s = 'MEDIUM' THEN 8 ELSE 3 END)::DOUBLE AS dependency FROM (SELECT *, {_LEVELS} AS s FROM events) GROUP BY 1""")
def health_deductions(spark, d):
    """What findings and known vulnerabilities of each kind take from a score."""
    rows = table(spark, d, "events").withColumn("s", F.expr(_LEVELS))
    sure = F.when(F.col("event_id") % 2 == 0, "HIGH").otherwise("LOW")
    return rows.groupBy("user_id").agg(F.sum(health.security_deduction(F.col("s"), sure)).alias("security"), F.sum(health.dependency_deduction(F.col("s"))).alias("dependency"))


_AUDIT = _RUNS + """, l AS (SELECT snapshot, kind, arg_max(v, (started, run)) AS v FROM r GROUP BY 1, 2), f AS (SELECT event_id % 1000 AS run, CASE event_id % 4 WHEN 0 THEN 'PY-COMPLEXITY-001' WHEN 1 THEN 'PYSEC001' WHEN 2 THEN 'JSSEC002' ELSE 'PY-FUNCTION-001' END AS rule_id, CASE event_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity FROM events WHERE event_id % 3 <> 0),
y AS (SELECT event_id % 500 AS run, CASE WHEN event_id % 7 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM events WHERE event_id % 2 = 0), o AS (SELECT user_id AS snapshot, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1),
j AS (SELECT s.snapshot, source_files, a.v AS a, d.v AS d, x.v AS x, coalesce(o.n, 0) AS proposals FROM s LEFT JOIN l a ON a.snapshot = s.snapshot AND a.kind = 'analysis' LEFT JOIN l d ON d.snapshot = s.snapshot AND d.kind = 'dependency' LEFT JOIN l x ON x.snapshot = s.snapshot AND x.kind = 'architecture' LEFT JOIN o ON o.snapshot = s.snapshot),
g AS (SELECT run, count(*) FILTER (rule_id LIKE '%COMPLEXITY%' OR rule_id LIKE '%FUNCTION%') AS c, count(*) FILTER (rule_id LIKE '%SEC%') AS sec, count(*) FILTER (rule_id LIKE '%SEC%' AND severity IN ('CRITICAL', 'HIGH')) AS bad FROM f GROUP BY 1),
h AS (SELECT run, count(*) AS n, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS bad FROM y GROUP BY 1),
m AS (SELECT j.*, r1.status AS ast, r2.status AS dst, r3.status AS xst, coalesce(g.c, 0) AS c, coalesce(g.sec, 0) AS sec, coalesce(g.bad, 0) AS bad, coalesce(h.n, 0) AS n, coalesce(h.bad, 0) AS vbad FROM j LEFT JOIN r r1 ON r1.run = a LEFT JOIN r r2 ON r2.run = d LEFT JOIN r r3 ON r3.run = x LEFT JOIN g ON g.run = a LEFT JOIN h ON h.run = d),
k AS (SELECT snapshot, 'AUDIT-INGEST-001' AS check_id, CASE WHEN snapshot % 4 <> 0 AND source_files > 0 THEN 'PASSED' ELSE 'WARNING' END AS state, source_files::BIGINT AS count FROM m
 UNION ALL SELECT snapshot, 'AUDIT-STATIC-001', CASE WHEN ast IS DISTINCT FROM 'completed' THEN 'SKIPPED' WHEN c > 10 THEN 'FAILED' WHEN c > 0 THEN 'WARNING' ELSE 'PASSED' END, c FROM m
 UNION ALL SELECT snapshot, 'AUDIT-SCA-001', CASE WHEN dst IS DISTINCT FROM 'completed' THEN 'SKIPPED' WHEN vbad > 0 THEN 'FAILED' WHEN n > 0 THEN 'WARNING' ELSE 'PASSED' END, n FROM m
 UNION ALL SELECT snapshot, 'AUDIT-APPSEC-001', CASE WHEN ast IS DISTINCT FROM 'completed' THEN 'SKIPPED' WHEN bad > 0 THEN 'FAILED' WHEN sec > 0 THEN 'WARNING' ELSE 'PASSED' END, sec FROM m
 UNION ALL SELECT snapshot, 'AUDIT-ARCH-001', CASE WHEN xst IS DISTINCT FROM 'completed' THEN 'SKIPPED' WHEN x % 4 > 0 THEN 'FAILED' WHEN x % 3 > 0 THEN 'WARNING' ELSE 'PASSED' END, coalesce(x % 4, 0) FROM m
 UNION ALL SELECT snapshot, 'AUDIT-REMEDIATION-001', CASE WHEN proposals > 0 THEN 'PASSED' ELSE 'WARNING' END, proposals FROM m)
"""


def _checks(spark, d) -> DataFrame:
    snapshots, runs = _runs(spark, d)
    rows, v = table(spark, d, "events"), F.col("event_id")
    rule = F.when(v % 4 == 0, "PY-COMPLEXITY-001").when(v % 4 == 1, "PYSEC001").when(v % 4 == 2, "JSSEC002").otherwise("PY-FUNCTION-001")
    findings = rows.filter(v % 3 != 0).select((v % 1000).alias("run"), rule.alias("rule_id"), F.when(v % 5 == 0, "CRITICAL").when(v % 5 == 1, "HIGH").otherwise("LOW").alias("severity"))
    known = rows.filter(v % 2 == 0).select((v % 500).alias("run"), F.when(v % 7 == 0, "HIGH").otherwise("LOW").alias("severity"))
    proposals = rows.filter((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0)).select(F.col("user_id").alias("snapshot"), F.lit("VALIDATED").alias("status"))
    named = snapshots.select("snapshot", F.when(F.col("snapshot") % 4 != 0, "completed").otherwise("failed").alias("status"), F.col("source_files").alias("files"))
    return audit.checks(named, runs, findings, known, proposals)


@query(_AUDIT + "SELECT * FROM k")
def audit_checks(spark, d):
    """Six checks of every snapshot over its latest runs, findings, known vulnerabilities and proposals."""
    return _checks(spark, d).select("snapshot", "check_id", "state", "count")


@query(_AUDIT + """, e AS (SELECT user_id AS snapshot, 'R' || event_id % 3 AS rule_id, 'HIGH' AS severity, event_type || '.py' AS path, event_id AS line, event_id + 1 AS end_line, 'value | ' || event_type AS evidence FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY path, line, rule_id, evidence) AS i, count(*) OVER (PARTITION BY snapshot) AS total FROM e),
t AS (SELECT snapshot, string_agg('| `' || rule_id || '` | ' || severity || ' | `' || path || '` | ' || line || '-' || end_line || ' | ' || replace(evidence, '|', '\\|') || ' |', chr(10) ORDER BY i) AS rows, any_value(total) AS total FROM n WHERE i <= 5 GROUP BY 1),
c AS (SELECT snapshot, string_agg('| `' || check_id || '` | ' || CASE check_id WHEN 'AUDIT-INGEST-001' THEN 'INGESTION' WHEN 'AUDIT-STATIC-001' THEN 'STATIC_ANALYSIS' WHEN 'AUDIT-SCA-001' THEN 'DEPENDENCY_SCA' WHEN 'AUDIT-APPSEC-001' THEN 'APPSEC_INTELLIGENCE' WHEN 'AUDIT-ARCH-001' THEN 'ARCHITECTURE_GOVERNANCE' ELSE 'REMEDIATION_VALIDATION' END || ' | **' || state || '** | ' || count || ' |', chr(10) ORDER BY check_id) AS rows,
 CASE WHEN bool_or(state = 'FAILED') THEN 'FAILED' WHEN bool_or(state = 'WARNING') THEN 'WARNING' ELSE 'PASSED' END AS overall FROM k GROUP BY 1)
SELECT c.snapshot, md5('# Audit of ' || c.snapshot || chr(10) || '- Outcome: **' || overall || '**' || chr(10) || '- Findings: ' || coalesce(total, 0) || chr(10) || chr(10) || '## Checks' || chr(10) || '| Check | Category | State | Count |' || chr(10) || '| :- | :- | :- | :- |' || chr(10) || c.rows
 || CASE WHEN total > 0 THEN chr(10) || chr(10) || '## Findings' || chr(10) || '| Rule | Severity | File | Lines | Evidence |' || chr(10) || '| :- | :- | :- | :- | :- |' || chr(10) || t.rows || CASE WHEN total > 5 THEN chr(10) || chr(10) || '*' || (total - 5) || ' more findings*' ELSE '' END ELSE '' END) AS report
FROM c LEFT JOIN t ON c.snapshot = t.snapshot""".replace("'\\\\|'", "'\\|'"))
def audit_reports(spark, d):
    """A report of each snapshot, of which the hash is shown."""
    v = F.col("event_id")
    findings = table(spark, d, "events").select(F.col("user_id").alias("snapshot"), F.concat(F.lit("R"), (v % 3).cast("string")).alias("rule_id"), F.lit("HIGH").alias("severity"), F.concat("event_type", F.lit(".py")).alias("path"), v.alias("line"), (v + 1).alias("end_line"), F.concat(F.lit("value | "), "event_type").alias("evidence"))
    return audit.report(_checks(spark, d), findings, 5).select("snapshot", F.md5("report").alias("report"))


# --- lists, guards, counters ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_total(spark, d):
    """A page with how many rows there are in all."""
    kept = relational.flagged(table(spark, d, "orders").withColumn("done", F.col("o_orderstatus") == "F"), "done", True)
    return relational.paged(kept, [F.desc("o_totalprice"), "o_orderkey"], 3, 25).select("o_orderkey", "o_totalprice", "total")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND epoch(TIMESTAMP '2024-01-10 00:00:00') - floor(epoch(ts)) < 120 * 600")
def running_guard(spark, d):
    """Runs that began too recently for another to begin."""
    runs = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("completed").alias("status"), F.col("ts").alias("started"))
    return relational.running(runs, "status", "started", F.lit("2024-01-10 00:00:00").cast("timestamp"), 120 * 600).select("event_id")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0)")
def missing_ids(spark, d):
    """Ids that are asked for and not there."""
    return relational.missing(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, d, "part").filter("p_size % 3 = 0").select(F.col("p_partkey").alias("k")), "k")


@query("SELECT l_partkey AS k, arg_min(l_orderkey, (l_linenumber <> 3, l_orderkey * 10 + l_linenumber)) AS l_orderkey FROM lineitem GROUP BY 1")
def preferred_lock(spark, d):
    """Of several lock entries of a package the first that is direct, else the first."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", (F.col("l_linenumber") == 3).alias("direct"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("turn"))
    return relational.preferred(rows, ["k"], "turn", "direct", ["l_orderkey"])


_LOG = "(SELECT CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'view' THEN 200 WHEN 'signup' THEN 302 ELSE 101 END AS status, CASE WHEN event_id % 2 = 0 THEN 'get' ELSE 'POST' END AS method, value - 10 AS duration FROM events)"


def _log(spark, d) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "error", 503).when(e == "click", 404).when(e == "view", 200).when(e == "signup", 302).otherwise(101)
    return table(spark, d, "events").select(status.alias("status"), F.when(F.col("event_id") % 2 == 0, "get").otherwise("POST").alias("method"), (F.col("value") - 10).alias("duration"))


@query(f"SELECT count(*) AS requests, count(*) FILTER (status = 404) AS errors_4xx, count(*) FILTER (status = 503) AS errors_5xx, round(avg(greatest(duration, 0)), 2) AS avg_duration, round(count(*) FILTER (status >= 400) / count(*) * 100.0::DOUBLE, 2) AS error_rate FROM {_LOG}")
def request_metrics(spark, d):
    return metrics.requests(_log(spark, d))


@query(f"SELECT upper(method) AS method, CASE WHEN status BETWEEN 200 AND 599 THEN status // 100 || 'xx' ELSE 'other' END AS status_class, count(*) AS n FROM {_LOG} GROUP BY 1, 2")
def request_counts(spark, d):
    return metrics.request_counts(_log(spark, d))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events)
SELECT state, count(*) AS n FROM (SELECT user_id, coalesce(arg_min(state, event_id) FILTER (state IN ('completed', 'failed')), arg_max(state, event_id)) AS state FROM s GROUP BY 1) GROUP BY 1""")
def task_states(spark, d):
    e = F.col("event_type")
    state = F.when(e == "signup", "pending").when(e.isin("view", "click"), "running").when(e == "purchase", "completed").otherwise("failed")
    return metrics.tasks(table(spark, d, "events").select("user_id", state.alias("state"), "event_id"), "user_id", "state", ["event_id"])


@query(ORACLES["task_states"])
def task_states_stream(spark, d):
    """The same from a stream that delivers the log out of order, a few files a batch."""
    base = f"{shared_dir(spark)}/tasks-{uuid.uuid4().hex}"
    e = F.col("event_type")
    state = F.when(e == "signup", "pending").when(e.isin("view", "click"), "running").when(e == "purchase", "completed").otherwise("failed")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("task"), state.alias("state"), F.col("event_id").alias("at"), F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(6, F.xxhash64("at")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    tasks.start(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return tasks.latest(spark.read.parquet(f"{base}/out")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# --- search --------------------------------------------------------------------------------------

_TOKENS = r"""list_concat(list_concat([lower(w)], CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '') ELSE [] END), list_concat(
 CASE WHEN len(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') || ' ', '[A-Z]?[a-z]+|[A-Z]+ |\d+')) > 1 THEN list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') || ' ', '[A-Z]?[a-z]+|[A-Z]+ |\d+'), lambda p: trim(lower(p))) ELSE [] END,
 CASE WHEN length(w) <= 4 THEN [] WHEN lower(w) LIKE '%ation' THEN [lower(w)[:-6], lower(w)[:-6] || 'ate'] WHEN lower(w) LIKE '%ing' AND length(w) > 5 THEN [lower(w)[:-4]] WHEN lower(w) LIKE '%ed' THEN [lower(w)[:-3], lower(w)[:-2]] WHEN lower(w) LIKE '%es' THEN [lower(w)[:-3]] WHEN lower(w) LIKE '%s' AND lower(w) NOT LIKE '%ss' THEN [lower(w)[:-2]] ELSE [] END))"""
#: The query's tokens, with how often each counts.
QUESTION = "webThing the those"
_ASKED = [("webthing", 1), ("web", 1), ("thing", 1), ("webth", 1), ("the", 1), ("those", 1)]


@query(f"""WITH d AS (SELECT doc_id, source || '_' || lang AS symbol, source || '.txt' AS file, source || '_' || lang || ' ' || source || '.txt ' || source || '/' || doc_id || ' ' || text AS whole FROM documents),
t AS (SELECT doc_id, symbol, file, flatten(list_transform(regexp_extract_all(whole, '[A-Za-z0-9_]+'), lambda w: {_TOKENS})) AS t FROM d), s AS (SELECT count(*) AS n, avg(len(t)) AS av FROM t),
q AS (SELECT * FROM {values(_ASKED, 'term, weight')}), h AS (SELECT doc_id, len(t) AS n, term, weight, len(list_filter(t, lambda x: x = term)) AS tf FROM t, q), f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1),
r AS (SELECT doc_id, sum(weight * ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * h.n / av))) AS raw FROM h JOIN f USING (term), s WHERE tf > 0 GROUP BY 1),
b AS (SELECT doc_id, coalesce(raw, 0) + CASE WHEN contains('webthing the those', lower(symbol)) THEN 3 WHEN contains(lower(symbol), 'webthing') OR contains(lower(symbol), 'thing') OR contains(lower(symbol), 'webth') OR contains(lower(symbol), 'those') THEN 2 ELSE 0 END
 + CASE WHEN contains('webthing the those', lower(file)) THEN 2 WHEN contains(lower(file), 'webthing') OR contains(lower(file), 'thing') OR contains(lower(file), 'webth') OR contains(lower(file), 'those') THEN 1.5 ELSE 0 END AS raw FROM t LEFT JOIN r USING (doc_id))
SELECT doc_id, round(raw, 6) AS raw_score FROM b WHERE raw > 0.001""")
def bm25_code(spark, d):
    """All documents that a query in words and identifiers scores on: symbol, file, path and text as one, in code tokens, with bonuses."""
    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", F.concat("source", F.lit("_"), "lang").alias("symbol_name"), F.concat("source", F.lit(".txt")).alias("file_name"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("relative_path"), F.col("text").alias("content"))
    return retrieval.code_search(chunks, QUESTION, "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS av FROM t), q AS (SELECT * FROM (VALUES ('the', 2), ('and', 1)) v(term, weight)),
h AS (SELECT doc_id, len(t) AS n, term, weight, len(list_filter(t, lambda x: x = term)) AS tf FROM t, q), f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(sum(weight * ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * h.n / av))), 6) AS raw_score FROM h JOIN f USING (term), s WHERE tf > 0 GROUP BY 1 HAVING raw_score > 0.001""")
def bm25_index(spark, d):
    """The same scores from an index of all terms, for a query that names one term twice."""
    docs = table(spark, d, "documents")
    postings, lengths = retrieval.index(docs, "doc_id", words(F.col("text")))
    return retrieval.search(postings, lengths, ["the", "and", "the"], "doc_id").select("doc_id", F.round("raw_score", 6).alias("raw_score"))


@query("""WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20), b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20),
f AS (SELECT coalesce(a.k, b.k) AS k, a.rank AS x, b.rank AS y, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS rrf FROM a FULL OUTER JOIN b ON a.k = b.k),
r AS (SELECT k, row_number() OVER (ORDER BY rrf DESC, coalesce(x, 41), coalesce(y, 41))::INT AS rank, rrf FROM f QUALIFY rank <= 10)
SELECT k, rank, round(rrf / max(rrf) OVER (), 9) AS score, 'hybrid' AS mode FROM r UNION ALL SELECT -k, rank::INT, 0.5::DOUBLE, 'lexical_fallback' FROM a WHERE rank <= 10""")
def hybrid_search(spark, d):
    """Two ranked lists as one; and, with keys below zero, what stays if the second is empty."""
    orders = table(spark, d, "orders")
    ranked = lambda *order: orders.orderBy(*order).limit(20).select(F.col("o_orderkey").alias("k"), F.row_number().over(W.orderBy(*order)).alias("rank"), F.lit(0.5).alias("score"))
    left = ranked(F.desc("o_totalprice"), "o_orderkey")
    right = ranked(F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey")
    both = retrieval.hybrid(left, right, "k", 10)
    alone = retrieval.hybrid(left, right.limit(0), "k", 10)
    return both.select("k", "rank", F.round("score", 9).alias("score"), "mode").unionByName(alone.select((-F.col("k")).alias("k"), "rank", "score", "mode"))


@query("SELECT count(*) AS chunks, count(embedding) AS vectors, true AS lexical, true AS semantic, 'HYBRID' AS status FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def search_capabilities(spark, d):
    chunks = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return retrieval.capabilities(chunks, "embedding")
