"""Module graphs: coupling, cycles, layers and the rules between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarrylight.functions.files import whole
from quarrylight.functions.text import fingerprint
from quarrylight.sources.shared import settled

#: So many edges are searched in one task; more are contracted by rounds first.
CORE = 200_000


def coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module, ca, ce, instability: distinct neighbours in and out; self-edges do not count."""
    own = edges.filter("source <> target").select("source", "target").distinct()
    out = own.groupBy(F.col("source").alias("m1")).agg(F.count(F.lit(1)).alias("ce"))
    into = own.groupBy(F.col("target").alias("m2")).agg(F.count(F.lit(1)).alias("ca"))
    both = modules.join(out, F.col("module") == F.col("m1"), "left").join(into, F.col("module") == F.col("m2"), "left")
    both = both.select("module", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return both.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 4)))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for nodes on a cycle, self-edges included.

    What makes graphs deep is taken out first: of nodes with one way out, or one way
    in, chains are followed by doubling, so a chain or cycle of n nodes takes some
    log(n) rounds (``_contracted``). Then colouring: every node takes the smallest
    node that reaches it, and a colour's component is what reaches its root
    backwards. Settled components leave the graph, and what is left goes again until
    no edge is; each round settles a component at least. Rows stay within the number
    of edges; no closure is built. As soon as no more than ``CORE`` edges are left, one
    task ends the search by depth first: a bounded rest, which the rounds would settle alike.
    """
    left = settled(edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").distinct(), "scc-edges")
    loops = left.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    found, undo = [], []
    left = settled(left.filter("source <> target"), "scc-left")
    while size := left.count():
        if size <= CORE:
            found.append(settled(_depth_first(left), "scc-core"))
            break
        left, whole, steps = _contracted(left)
        found.append(whole)
        undo.append(steps)
        if left.isEmpty():
            break
        if left.count() <= CORE:
            continue
        nodes = left.select(F.col("source").alias("node")).union(left.select(F.col("target").alias("node"))).distinct()
        colours = _spread(left, nodes.select("node", F.col("node").alias("value")))
        own = left.join(colours.select(F.col("node").alias("source"), F.col("value").alias("c1")), "source").join(colours.select(F.col("node").alias("target"), F.col("value").alias("c2")), "target").filter("c1 = c2")
        back = own.select(F.col("target").alias("source"), F.col("source").alias("target"))
        marks = _spread(settled(back, "scc-back"), colours.select("node", F.when(F.col("node") == F.col("value"), F.col("value")).alias("value")))
        done = settled(marks.filter(F.col("value").isNotNull()), "scc-done")
        found.append(done.select("node", F.col("value").alias("component")))
        gone = done.select(F.col("node").alias("gone"))
        left = settled(left.join(gone, F.col("source") == F.col("gone"), "left_anti").join(gone, F.col("target") == F.col("gone"), "left_anti"), "scc-left")
    members = settled(reduce(DataFrame.unionByName, found, loops.limit(0)).groupBy("node").agg(F.min("component").alias("component")), "scc-members")
    for steps in reversed(undo):
        members = _expanded(members, steps)
    members = members.unionByName(loops.join(members.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_anti"))
    # Components of one node count only with a self-edge.
    named = members.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    kept = members.join(named, "component").select("node", F.col("least").alias("component"), "n")
    looped = loops.select(F.col("node").alias("looped"))
    return kept.join(looped, F.col("node") == F.col("looped"), "left").filter("n > 1 OR looped IS NOT NULL").select("node", "component")


def _depth_first(edges: DataFrame) -> DataFrame:
    """node, component of ``CORE`` edges at most, in one task: one pass by depth, with the stack kept by hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ways.setdefault(a, []).append(b)
        met, low, open_, path, rows = {}, {}, set(), [], []

        def enter(node):
            met[node] = low[node] = len(met)
            path.append(node)
            open_.add(node)
            work.append((node, iter(ways.get(node, ()))))

        for root in sorted(ways):
            work: list = []
            if root not in met:
                enter(root)
            while work:
                node, rest = work[-1]
                for n in rest:
                    if n not in met:
                        enter(n)
                        break
                    if n in open_:
                        low[node] = min(low[node], met[n])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == met[node]:
                        members = [path.pop()]
                        while members[-1] != node:
                            members.append(path.pop())
                        open_.difference_update(members)
                        least = min(members)
                        rows += [(m, least) for m in members]
        yield pa.RecordBatch.from_pylist([{"node": n, "component": c} for n, c in rows], batch_schema)

    kind = edges.schema["source"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    batch_schema = pa.schema([(n, to_arrow_type(kind)) for n in ("node", "component")])
    return edges.coalesce(1).mapInArrow(run, schema)


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """Edges without nodes that have one neighbour on a side; components found on the way; and the steps, to put nodes back.

    A node with one way out, to t, lies in the component of t or in none: each edge
    into it is drawn on to t and it goes. Chains of such nodes are followed to
    their end by doubling. Those that never end lead into a cycle of such nodes,
    which is a component: nothing leaves it. The same is done with the edges turned
    round, until neither takes out a tenth of the edges.
    """
    alone, steps, turned, idle = [], [], False, 0
    edges = settled(_on_both_sides(edges), "scc-sided")
    before = edges.count()
    while idle < 2 and before:
        out = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("next"))
        # Nodes without a way out are on no cycle; what leads to them ends there.
        single = settled(out.filter("n = 1").select("node", "next"), "scc-single")
        if single.isEmpty():
            edges, turned, idle = edges.select(F.col("target").alias("source"), F.col("source").alias("target")), not turned, idle + 1
            continue
        jumps, at = [], settled(single.select("node", F.col("next").alias("to"), F.least("node", "next").alias("least")), "scc-jump")
        for _ in range(max(1, single.count()).bit_length() + 1):
            jumps.append(at.select("node", "to"))
            further = at.select(F.col("node").alias("via"), F.col("to").alias("on"), F.col("least").alias("l"))
            moved = at.join(further, F.col("to") == F.col("via"), "left").select("node", F.coalesce("on", "to").alias("to"), F.least("least", "l").alias("least"), F.col("via").isNotNull().alias("__moved"))
            moved = settled(moved, "scc-jump")
            at = moved.select("node", "to", "least")
            if moved.filter("__moved").isEmpty():
                break
        ends = single.select(F.col("node").alias("s"))
        endless = at.join(ends, F.col("to") == F.col("s"), "left_semi")
        circle = settled(endless.select(F.col("to").alias("node")).distinct().join(at.select("node", "least"), "node").select("node", F.col("least").alias("component")), "scc-circle")
        alone.append(circle)
        ended = at.join(ends, F.col("to") == F.col("s"), "left_anti").select("node", F.col("to").alias("end"))
        # Edges go on from the end of what they lead into; those of single nodes, and into endless chains, go.
        stay = edges.join(single.select(F.col("node").alias("s")), F.col("source") == F.col("s"), "left_anti")
        lost = endless.select(F.col("node").alias("e"))
        stay = stay.join(lost, F.col("target") == F.col("e"), "left_anti")
        drawn = stay.join(ended, F.col("target") == F.col("node"), "left").select("source", F.coalesce("end", "target").alias("target"), F.col("target").alias("into"), F.col("node").isNotNull().alias("__drawn"))
        drawn = settled(drawn, "scc-drawn")
        entries = drawn.filter("__drawn").select("source", "into").distinct()
        steps.append((ended, entries, jumps))
        turned_to = drawn.filter("source <> target").select("source", "target").distinct()
        # A self-edge says that its node is on a cycle with what was taken out.
        alone.append(drawn.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component")).distinct())
        # Nodes that now lack a way in or out go once.
        kept = _on_both_sides(turned_to)
        edges = settled(kept.select(F.col("target").alias("source"), F.col("source").alias("target")), "scc-turned")
        turned, after = not turned, edges.count()
        idle, before = idle + 1 if after > 0.9 * before else 0, after
    if turned:
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    none = edges.sparkSession.createDataFrame([], edges.select(F.col("source").alias("node"), F.col("source").alias("component")).schema)
    return edges, reduce(DataFrame.unionByName, alone, none), steps


def _expanded(members: DataFrame, steps: list) -> DataFrame:
    """Members with the nodes that ``steps`` took out and that lie in a component after all.

    A node on the chain to t is in t's component if some node of it enters the chain
    at or before the node. Entries are passed along the chains by the same doubling.
    """
    for ended, entries, jumps in reversed(steps):
        of = members.select(F.col("node").alias("m"), "component")
        goal = ended.join(of, F.col("end") == F.col("m")).select("node", "component")
        entered = entries.join(members.select(F.col("node").alias("source"), F.col("component").alias("from")), "source")
        reached = entered.join(goal, (F.col("into") == F.col("node")) & (F.col("from") == F.col("component"))).select("node").distinct()
        reached = settled(reached, "scc-reached")
        for jump in jumps:
            further = reached.join(jump, "node").select(F.col("to").alias("node"))
            reached = settled(reached.union(further).distinct(), "scc-reached")
        back = goal.join(reached, "node", "left_semi")
        members = settled(members.unionByName(back), "scc-members")
    return members


def _on_both_sides(edges: DataFrame) -> DataFrame:
    """Edges whose source is some edge's target and the other way round: one trimming step."""
    into, out = edges.select(F.col("target").alias("t")).distinct(), edges.select(F.col("source").alias("s")).distinct()
    return edges.join(into, F.col("source") == F.col("t"), "left_semi").join(out, F.col("target") == F.col("s"), "left_semi")


def _spread(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Each node's smallest value among those that reach it, by rounds until nothing changes."""
    values = settled(values, "scc-values")
    while True:
        sent = edges.join(values.select(F.col("node").alias("source"), "value"), "source").groupBy(F.col("target").alias("t")).agg(F.min("value").alias("v"))
        joined = values.join(sent, F.col("node") == F.col("t"), "left").select("node", F.least("value", "v").alias("value"), (~F.least("value", "v").eqNullSafe(F.col("value"))).alias("moved"))
        joined = settled(joined, "scc-values")
        values = joined.select("node", "value")
        if joined.filter("moved").isEmpty():
            return values


def layer_of(path: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """The first layer, in declared order, one of whose patterns matches the path."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(layers):
        out = F.when(reduce(lambda a, b: a | b, [glob(path, p) for p in patterns]), F.lit(name)).otherwise(out)
    return out


def glob(path: Column, pattern: str) -> Column:
    """Shell-style match of the whole path, or of what follows any slash."""
    return path.rlike(f"{whole(pattern)}|{whole('*/' + pattern)}")


def glob_rows(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges joined with the rows of ``patterns`` (from_pattern, to_pattern, ...) that match source and target.

    Patterns are a policy's, a handful of rows, and are broadcast; they become
    expressions once a row, not once a pair.
    """
    kinds = patterns.schema
    rows = [tuple(r) + tuple(f"{whole(r[c])}|{whole('*/' + r[c])}" for c in ("from_pattern", "to_pattern")) for r in patterns.collect()]  # a policy's rows
    made = edges.sparkSession.createDataFrame(rows, T.StructType([*kinds.fields, T.StructField("__from", T.StringType()), T.StructField("__to", T.StringType())]))
    return edges.join(F.broadcast(made), F.expr("rlike(source, __from)") & F.expr("rlike(target, __to)")).drop("__from", "__to")


def rule_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges between layers that a rule forbids or does not allow.

    ``edges``: source, target, from_layer, to_layer. ``rules``: rule_id, layer,
    forbidden (a layer or null), allowed (array of layers or null); a handful of rows.
    """
    known = edges.filter(F.col("from_layer").isNotNull() & F.col("to_layer").isNotNull() & (F.col("from_layer") != F.col("to_layer")))
    bad = (F.col("to_layer") == F.col("forbidden")) | ~F.array_contains("allowed", F.col("to_layer"))
    return known.join(rules, F.col("from_layer") == F.col("layer")).filter(F.coalesce(bad, F.col("to_layer") == F.col("forbidden"))).select("rule_id", "source", "target", "from_layer", "to_layer")


def module_metrics(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module, ca, ce, instability, abstractness, distance.

    ``modules``: module, classes, abstract_classes; ``edges``: source, target, those
    inside alone. Abstractness is null without a class, distance (from the line where
    abstractness and instability add up to one) if either is.
    """
    both = coupling(modules.select("module"), edges)
    share = F.when(F.col("classes") > 0, F.round(F.col("abstract_classes") / F.col("classes"), 4))
    known = modules.select(F.col("module").alias("__m"), share.alias("abstractness"))
    return both.join(known, F.col("module") == F.col("__m")).select("module", "ca", "ce", "instability", "abstractness", F.round(F.abs(F.col("abstractness") + F.col("instability") - 1), 4).alias("distance"))


def module_list(metrics: DataFrame, search: str | None = None, by: str = "coupling") -> DataFrame:
    """Modules whose name holds ``search``, most coupled first, or by instability (nulls last), afferent, efferent or name; ties by name."""
    orders = {"instability": [F.col("instability").desc_nulls_last()], "afferent": [F.desc("ca")], "efferent": [F.desc("ce")], "name": []}
    kept = metrics if not search else metrics.filter(F.contains(F.lower("module"), F.lit(search.strip().lower())))
    return kept.orderBy(*orders.get(by, [F.desc(F.col("ca") + F.col("ce"))]), "module")


def most_coupled(metrics: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The ``limit`` modules with the most neighbours on one side (ca or ce); of those, the ones that have any."""
    return metrics.orderBy(F.desc(column), "module").limit(limit).filter(F.col(column) > 0)


def graph_summary(metrics: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: modules, edges by kind (internal, external, unresolved), cycles, and modules without any neighbour."""
    sides = metrics.agg(F.count(F.lit(1)).alias("modules"), F.count_if((F.col("ca") == 0) & (F.col("ce") == 0)).alias("isolated"))
    kinds = edges.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("internal", "external", "unresolved")])
    cycles = components.agg(F.count_distinct("component").alias("cycles"))
    return sides.join(kinds).join(cycles)  # one row each


def module_detail(module: str, edges: DataFrame, components: DataFrame, violations: DataFrame) -> DataFrame:
    """What there is to say of one module, as rows (part, other, line): neighbours in and out, packages, what is not resolved, those on its cycles, violations."""
    inside = F.col("kind") == "internal"
    own = F.col("source") == module
    part = F.when((F.col("target") == module) & inside, "incoming").when(own & inside, "outgoing").when(own & (F.col("kind") == "external"), "external").when(own & (F.col("kind") == "unresolved"), "unresolved")
    listed = edges.select(part.alias("part"), F.when(F.col("target") == module, F.col("source")).otherwise(F.col("target")).alias("other"), "line").filter("part IS NOT NULL")
    loop = edges.filter(own & inside & (F.col("target") == module)).select(F.lit("outgoing").alias("part"), F.col("target").alias("other"), "line")
    of = components.filter(F.col("node") == module).select(F.col("component").alias("__c"))
    cycle = components.join(F.broadcast(of), F.col("component") == F.col("__c")).select(F.lit("cycle").alias("part"), F.col("node").alias("other"), F.lit(None).cast("int").alias("line"))  # one row
    broken = violations.filter((F.col("source") == module) | (F.col("target") == module)).select(F.lit("violation").alias("part"), F.col("rule_id").alias("other"), "line")
    return listed.unionByName(loop).unionByName(cycle).unionByName(broken)


def governance(modules: DataFrame, edges: DataFrame, policy: dict, components: DataFrame | None = None) -> DataFrame:
    """Everything in a module graph that a policy forbids: one row a different violation.

    ``modules``: module. ``edges``: source, target, specifier, line, kind. ``policy``: what
    ``policies.parsed`` gives. Layers and their rules look at edges inside, patterns at
    those to packages too, cycles at ``components``. Violations with one fingerprint
    (rule, ends, boundary) are one: the first kind of rule, then the first line.
    """
    spark = edges.sparkSession
    layers = [(x["name"], x["patterns"]) for x in policy["layers"]]
    low = F.regexp_replace(F.replace(F.col("module"), F.lit("\\"), F.lit("/")), "^[./]+", "")
    of = modules.select("module", (layer_of(low, [(n, [p.replace("\\", "/").lstrip("./") for p in ps]) for n, ps in layers]) if layers else F.lit(None).cast("string")).alias("layer")).filter("layer IS NOT NULL")
    inside = edges.filter("kind = 'internal'").join(of.select(F.col("module").alias("source"), F.col("layer").alias("from_layer")), "source").join(of.select(F.col("module").alias("target"), F.col("layer").alias("to_layer")), "target").filter("from_layer <> to_layer")
    found = []
    rules = [(r["id"], r["from_layer"], r["forbidden_to_layer"], r["allowed_to_layers"], r["severity"]) for r in policy["rules"]]
    if rules:
        known = spark.createDataFrame(rules, "rule_id string, layer string, forbidden string, allowed array<string>, severity string")
        met = inside.join(F.broadcast(known), F.col("from_layer") == F.col("layer"))  # a policy's rules
        boundary = F.concat("from_layer", F.lit(" -> "), "to_layer").alias("boundary")
        place = ["rule_id", "severity", "source", "target", "specifier", "line", boundary]
        found.append(met.filter("forbidden = to_layer").select(*place, F.lit(0).alias("turn"), F.lit("layer_forbidden").alias("kind")))
        found.append(met.filter("allowed IS NOT NULL AND NOT array_contains(allowed, to_layer)").select(*place, F.lit(1).alias("turn"), F.lit("allowed_layers_mismatch").alias("kind")))
    patterns = [(r["id"], r["from_pattern"], r["to_pattern"], r["severity"]) for r in policy["forbidden"]]
    if patterns:
        rows = spark.createDataFrame(patterns, "rule_id string, from_pattern string, to_pattern string, severity string")
        met = glob_rows(edges.filter("kind IN ('internal', 'external')").drop("kind"), rows)
        found.append(met.select("rule_id", "severity", "source", "target", "specifier", "line", F.concat("from_pattern", F.lit(" -> "), "to_pattern").alias("boundary"), F.lit(2).alias("turn"), F.lit("forbidden_pattern").alias("kind")))
    if policy["disallow_cycles"] and components is not None:
        # A cycle is named by its two smallest modules, or by its one.
        cycles = components.groupBy("component").agg(F.min("node").alias("source"), F.min(F.when(F.col("node") != F.col("component"), F.col("node"))).alias("second"))
        second = F.coalesce("second", "source")
        found.append(cycles.select(F.lit("ARCH-CYCLE-DETECTED").alias("rule_id"), F.lit("HIGH").alias("severity"), "source", second.alias("target"), second.alias("specifier"), F.lit(1).alias("line"), F.lit("cyclic_dependency").alias("boundary"), F.lit(3).alias("turn"), F.lit("cycle_disallowed").alias("kind")))
    if not found:
        return spark.createDataFrame([], "fingerprint string, rule_id string, severity string, source string, target string, specifier string, line int, boundary string, kind string")
    every = reduce(DataFrame.unionByName, found)
    print_ = fingerprint(F.col("rule_id"), F.col("source"), F.col("target"), F.col("boundary"))
    once = every.groupBy(print_.alias("fingerprint")).agg(F.min_by(F.struct("rule_id", "severity", "source", "target", "specifier", "line", "boundary", "kind"), F.struct("turn", "line", "specifier")).alias("v"))
    return once.select("fingerprint", "v.*")
