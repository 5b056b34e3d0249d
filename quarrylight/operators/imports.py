"""Imports resolved against the files of a snapshot: candidates in order, a join, the first that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a script import may leave out, in order of preference.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".cjs", ".mjs")


def _beside(folder: Column, path: Column) -> Column:
    return F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path))


def _parent(folder: Column) -> Column:
    return F.when(F.instr(folder, "/") > 0, F.regexp_replace(folder, "/[^/]*$", "")).otherwise(F.lit(""))


def python_candidates(source: Column, module: Column, name: Column, is_from: Column, level: Column) -> Column:
    """Paths that an import may mean, the likeliest first.

    Relative imports climb one folder a level beyond the first. Absolute ones try
    their longest prefix first, from the root and then from the three folders
    around the importing file.
    """
    folder = _parent(source)
    steps = F.split(folder, "/")
    up = F.when(level > 1, F.array_join(F.slice(steps, F.lit(1), F.greatest(F.lit(0), F.size(steps) - level + 1)), "/")).otherwise(folder)
    start = F.when(F.coalesce(module, F.lit("")) == "", up).otherwise(_beside(up, F.replace(module, F.lit("."), F.lit("/"))))
    inner = _beside(start, name)
    relative = F.array(F.concat(inner, F.lit(".py")), F.concat(inner, F.lit("/__init__.py")), F.concat(start, F.lit(".py")), F.concat(start, F.lit("/__init__.py")))
    parts = F.split(full_name(module, name, is_from), r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    files = F.flatten(F.transform(prefixes, lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    around = [folder, _parent(folder), _parent(_parent(folder))]
    none = F.array().cast("array<string>")
    nearby = [F.when(f != "", F.transform(files, lambda p, f=f: F.concat(f, F.lit("/"), p))).otherwise(none) for f in around]
    return F.when(level > 0, relative).otherwise(F.concat(files, *nearby))


def full_name(module: Column, name: Column, is_from: Column) -> Column:
    return F.when(is_from & (F.coalesce(module, F.lit("")) != ""), F.concat(module, F.lit("."), name)).otherwise(name)


def script_candidates(source: Column, name: Column) -> Column:
    """The path itself, then with each ending, then an index file; names from the root try both for each ending."""
    relative = name.rlike(r"^\.\.?/")
    joined = F.split(_beside(_parent(source), name), "/")
    climbed = F.aggregate(
        joined, F.array().cast("array<string>"),
        lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(p))),
    )
    base = F.when(relative, F.array_join(climbed, "/")).otherwise(name)
    files, folders = [[F.concat(base, F.lit(f"{stem}{e}")) for e in SCRIPT_ENDINGS] for stem in ("", "/index")]
    mixed = [c for pair in zip(files, folders, strict=True) for c in pair]
    return F.when(relative, F.array(base, *files, *folders)).otherwise(F.array(base, *mixed))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """source, line, name, target, kind (internal, external, unresolved); one row per edge, its first line.

    ``imports``: source, language, module, name, is_from, level, line. ``files``:
    path. Candidates are joined with the files as rows and the first that exists
    is chosen by an aggregate, so neither side is ever held in one place.
    """
    asked = imports.select("source", "language", "module", "name", "is_from", "level", "line").distinct()
    is_python = F.lower("language") == "python"
    relative = F.when(is_python, F.col("level") > 0).otherwise(F.col("name").rlike(r"^\.\.?/"))
    paths = F.when(is_python, python_candidates(F.col("source"), F.col("module"), F.col("name"), F.col("is_from"), F.col("level"))).otherwise(script_candidates(F.col("source"), F.col("name")))
    full = F.when(is_python, full_name(F.col("module"), F.col("name"), F.col("is_from"))).otherwise(F.col("name"))
    known = files.select(F.col("path").alias("__path")).distinct()
    tops = known.select(F.regexp_replace(F.split_part("__path", F.lit("/"), F.lit(1)), r"\.py$", "").alias("__top")).distinct()
    # An import that nothing answers is named by its likeliest path.
    missing = F.when(relative, F.regexp_replace(F.get(paths, F.lit(0)), r"\.py$", "")).otherwise(full)
    rows = asked.withColumn("__missing", missing).withColumn("__full", full).withColumn("__first", F.split_part("__full", F.lit("."), F.lit(1)))
    by = [c for c in rows.columns]
    tried = rows.select(*by, F.posexplode(paths).alias("__rank", "__want")).join(known, F.col("__want") == F.col("__path"), "left")
    best = tried.groupBy(*by).agg(F.min(F.when(F.col("__path").isNotNull(), F.struct("__rank", "__path"))).alias("__best"))
    best = best.join(tops, F.col("__first") == F.col("__top"), "left")
    hit = F.col("__best").isNotNull()
    inside = is_python & F.col("__top").isNotNull()
    kind = F.when(hit, "internal").when(relative | inside, "unresolved").otherwise("external")
    package = F.when(is_python, F.col("__first")).otherwise(F.regexp_extract("name", r"^(@[^/]+/[^/]+|[^/]+)", 1))
    target = F.when(hit, F.col("__best.__path")).when(kind == "external", package).otherwise(F.col("__missing"))
    edges = best.select("source", "line", "name", target.alias("target"), kind.alias("kind"))
    return edges.groupBy("source", "target", "name", "kind").agg(F.min("line").alias("line")).select("source", "line", "name", "target", "kind")
