"""Dependency manifests as rows: Spark reads the files, a small parser per format runs in the tasks."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources import discovery
from quarrylight.sources.shared import settled

try:
    import yaml
except ImportError:
    yaml = None

SCHEMA = "path string, ecosystem string, package string, constraint string, resolved string, kind string, is_direct boolean, scope string, status string, line int"
#: Requirement files that a requirement file names are followed so many steps.
DEPTH = 5
_PIN = re.compile(r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*(\(?[^;#@()]*\)?)\s*(?:;\s*(.+))?$")
_SPEC = re.compile(r"(?:===|==|~=|!=|<=|>=|<|>)\s*[^\s,;]+")
# Lines that begin with these set options and require nothing.
OPTIONS = ("-i", "--index-url", "--extra-index-url", "-f", "--find-links", "--trusted-host", "--no-index")
_URLS = ("git+", "http://", "https://", "svn+", "hg+")


def files(spark: SparkSession, root: str) -> DataFrame:
    """path and content of every manifest under ``root``."""
    found = discovery.files(spark, root).filter(is_manifest(F.col("path")))
    return found.select("path", F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8").alias("content"))


def _pypi(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.strip()).lower()


def _row(ecosystem: str, package: str, constraint: str | None = None, resolved: str | None = None, kind: str = "direct", is_direct: bool | None = True, scope: str | None = None, status: str | None = None, line: int | None = None) -> tuple:
    return ecosystem, package, constraint, resolved, kind, is_direct, scope, status or ("resolved" if resolved else "unresolved"), line


def _requirement(text: str, kind: str, scope: str | None = None, line: int | None = None) -> Iterator[tuple]:
    """A requirement by name; a single exact version resolves it. What is none gives a row of kind error."""
    m = _PIN.match(text)
    specs = _SPEC.findall(m[2]) if m else []
    if not m or re.sub(r"[\s,()]", "", m[2]) != re.sub(r"\s", "", "".join(specs)):
        yield _row("pypi", None, text, None, "error", None, None, "error", line)
        return
    specs = sorted(re.sub(r"\s", "", x) for x in specs)
    exact = specs[0][2:] if len(specs) == 1 and re.match(r"==[^=]", specs[0]) and "*" not in specs[0] else None
    yield _row("pypi", _pypi(m[1]), ",".join(specs) or None, exact, kind, True, scope or (m[3].strip() if m[3] else None), None, line)


def requirements(text: str, path: str = "requirements.txt") -> Iterator[tuple]:
    """Lines with continuations joined. Other files, editable installs and addresses are rows with a status; options are passed over."""
    joined, current, first = [], "", 1
    for i, line in enumerate(text.splitlines(), 1):
        first = first if current else i
        line = line.strip()
        current += " " + line.removesuffix("\\").strip()
        if not line.endswith("\\"):
            joined.append((first, current.strip()))
            current = ""
    if current:
        joined.append((first, current.strip()))
    egg = re.compile(r"#egg=([a-zA-Z0-9_\-.]+)")
    for n, line in joined:
        if not line or line.startswith("#") or line.startswith(OPTIONS):
            continue
        if m := re.match(r"(?:-r|--requirement)\s+([^\s#]+)", line):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), m[1]))
            yield _row("pypi", _pypi(m[1]), target, None, "included_manifest", None, None, "unresolved_inclusion", n)
        elif m := re.match(r"(?:-e|--editable)\s+(\S+)", line):
            name = egg.search(m[1])
            yield _row("pypi", _pypi(name[1] if name else m[1]), None, None, "direct", None, None, "unsupported_editable", n)
        else:
            line = line.split(" #", 1)[0].strip()
            if any(u in line for u in _URLS):
                name = egg.search(line)
                yield _row("pypi", _pypi(name[1] if name else line.split("/")[-1].split(".")[0]), None, None, "direct", None, None, "unresolved_url", n)
            else:
                yield from _requirement(re.sub(r"\s--hash=\S+", "", line), "direct", None, n)


def pyproject(text: str) -> Iterator[tuple]:
    data = tomllib.loads(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    for line in project.get("dependencies", []):
        yield from _requirement(line, "direct")
    for extra, lines in project.get("optional-dependencies", {}).items():
        for line in lines:
            yield from _requirement(line, "optional", f"extra:{extra}")
    groups = [("direct", "main", poetry.get("dependencies", {})), ("dev", "dev", poetry.get("dev-dependencies", {}))]
    groups += [("dev" if name == "dev" else "optional", f"group:{name}", g.get("dependencies", {})) for name, g in poetry.get("group", {}).items()]
    for kind, scope, group in groups:
        for name, spec in group.items():
            if name.lower() != "python":
                told = spec if isinstance(spec, str) else spec.get("version") if isinstance(spec, dict) else None
                exact = told[2:].strip() if isinstance(told, str) and told.startswith("==") and "*" not in told else None
                optional = isinstance(spec, dict) and spec.get("optional")
                yield _row("pypi", _pypi(name), told, exact, "optional" if optional else kind, True, scope)


def poetry_lock(text: str) -> Iterator[tuple]:
    for p in tomllib.loads(text).get("package", []):
        name, version, scope = p.get("name"), p.get("version"), p.get("category", "main")
        if name and version:
            yield _row("pypi", _pypi(name), None, version.strip(), "optional" if p.get("optional") else "dev" if scope == "dev" else "direct", None, scope)


def pipfile_lock(text: str) -> Iterator[tuple]:
    data = json.loads(text)
    for section, kind in (("default", "direct"), ("develop", "dev")):
        for name, spec in data.get(section, {}).items():
            if isinstance(spec, dict):
                version = spec.get("version", "") if isinstance(spec.get("version", ""), str) else ""
                yield _row("pypi", _pypi(name), version or None, version.lstrip("=").strip() or None, kind, True, section)


def package_json(text: str) -> Iterator[tuple]:
    """Declared ranges; nothing is resolved, however exact a range is."""
    data = json.loads(text)
    places: dict[str, int] = {}
    for i, line in enumerate(text.splitlines(), 1):
        if m := re.search(r'"([^"]+)"\s*:', line):
            places.setdefault(m[1], i)
    for section, kind, scope in (("dependencies", "direct", "production"), ("devDependencies", "dev", "development"), ("optionalDependencies", "optional", "optional"), ("peerDependencies", "peer", "peer")):
        for name, constraint in (data.get(section) or {}).items():
            if isinstance(constraint, str):
                yield _row("npm", name.strip().lower(), constraint.strip(), None, kind, True, scope, None, places.get(name))


def package_lock(text: str) -> Iterator[tuple]:
    """Version 1 trees and later maps. What is nested, or what the root does not name, is transitive; a map whose root names nothing counts as direct."""
    data = json.loads(text)
    scope = lambda spec: "development" if spec.get("dev") else "production"
    if "packages" in data:
        root = data["packages"].get("", {})
        plain, dev = ({*(root.get(k) or {})} for k in ("dependencies", "devDependencies"))
        for place, spec in data["packages"].items():
            depth = place.count("node_modules/")
            name = (spec.get("name") or place.rpartition("node_modules/")[2].rstrip("/")) if isinstance(spec, dict) and depth else ""
            if not name or not isinstance(spec.get("version"), str):
                continue
            low, kind, direct = name.strip().lower(), "transitive", False
            if depth == 1:
                if {name, low} & plain:
                    kind, direct = "direct", True
                elif {name, low} & dev:
                    kind, direct = "dev", True
                elif not plain and not dev:
                    kind, direct = ("dev", False) if spec.get("dev") else ("direct", True)
            yield _row("npm", low, None, spec["version"].strip(), kind, direct, scope(spec))
        return
    todo = [(data.get("dependencies", {}), True)]
    while todo:
        some, top = todo.pop()
        for name, spec in some.items():
            if isinstance(spec, dict) and isinstance(spec.get("version"), str):
                yield _row("npm", name.strip().lower(), None, spec["version"].strip(), ("dev" if spec.get("dev") else "direct") if top else "transitive", top, scope(spec))
                todo.append((spec.get("dependencies") or {}, False))


def yarn_lock(text: str) -> Iterator[tuple]:
    """Version 1 blocks; newer formats are no such thing and are refused."""
    if re.search(r"^__metadata:", text, re.M):
        raise ValueError("not version 1")
    name = None
    for line in text.splitlines():
        if line and not line[0].isspace() and not line.startswith("#"):
            name = line.split(",")[0].strip().strip('":').rpartition("@")[0].strip('"')
        elif name and (m := re.match(r'\s+version "?([^"\s]+)"?$', line)):
            yield _row("npm", name.lower(), None, m[1], "direct", None, "production")
            name = None


def pnpm_lock(text: str) -> Iterator[tuple]:
    """Packages with their versions, without peers in brackets or after an underscore; direct if the root names them."""
    if yaml is None:
        raise ValueError("no reader of YAML is installed")
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e
    roots = [data, (data.get("importers") or {}).get(".") or {}]
    plain, dev = ({n for r in roots for n in r.get(k) or {}} for k in ("dependencies", "devDependencies"))
    for key, told in (data.get("packages") or {}).items():
        m = re.match(r"/*(@[^/@]+/[^/@]+|[^/@]+)[/@]([^(_/@]+)", str(key))
        if m:
            name = m[1].lower()
            is_dev = name in dev or bool(isinstance(told, dict) and told.get("dev"))
            yield _row("npm", name, None, m[2].strip(), "transitive" if name not in plain | dev else "dev" if is_dev else "direct", name in plain | dev, "development" if is_dev else "production")


#: Parsers by file name; requirement files by their pattern.
PARSERS = {
    "pyproject.toml": pyproject, "poetry.lock": poetry_lock, "pipfile.lock": pipfile_lock,
    "package.json": package_json, "package-lock.json": package_lock, "yarn.lock": yarn_lock, "pnpm-lock.yaml": pnpm_lock,
}


def parser_of(path: str):
    """The parser of a file by its name, in any case; None if it is no manifest."""
    name = path.replace("\\", "/").lower().rpartition("/")[2]
    if name.startswith("requirements") and name.endswith(".txt"):
        return lambda text: requirements(text, path.replace("\\", "/"))
    return PARSERS.get(name)


def is_manifest(path: Column) -> Column:
    """The same by a Column, to choose files before they are read."""
    name = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    return name.rlike(r"^requirements.*\.txt\z") | name.isin(*PARSERS)


def inventory(manifests: DataFrame) -> DataFrame:
    """One row per dependency of every (path, content) row; a file that cannot be parsed gives one row of kind ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = parser_of(path or "")
                if parser is None or text is None:
                    continue
                try:
                    rows += [(path, *r) for r in parser(text)]
                except (ValueError, KeyError, AttributeError, TypeError):
                    rows.append((path, *_row(None, None, None, None, "error", None, None, "error")))
            columns = zip(*rows, strict=True) if rows else [()] * 10
            kinds = [pa.string()] * 6 + [pa.bool_(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return manifests.filter(is_manifest(F.col("path"))).select("path", "content").mapInArrow(run, SCHEMA)


def included(found: DataFrame) -> DataFrame:
    """The rows of ``inventory`` with those of requirement files that others name, under each file that leads to them.

    Adds ``root``: the file that was asked about. An inclusion whose file is there gives
    that file's rows instead of its own; one that is not there stays as a row. Chains
    are followed DEPTH steps, each file once for a root, so circles end.
    """
    files = found.select("path").distinct()
    links = found.filter("kind = 'included_manifest'").select(F.col("path").alias("from"), F.col("constraint").alias("to")).distinct()
    links = settled(links.join(files.select(F.col("path").alias("to")), "to").select("from", "to"), "links")
    reach = files.select(F.col("path").alias("root"), F.col("path").alias("at"))
    last = reach
    for _ in range(DEPTH):
        last = last.join(links, F.col("at") == F.col("from")).select("root", F.col("to").alias("at")).distinct()
        reach = reach.unionByName(last).distinct()
    known = links.select(F.col("from").alias("__f"), F.col("to").alias("__t"))
    open_ = found.join(known, (F.col("path") == F.col("__f")) & (F.col("constraint") == F.col("__t")) & (F.col("kind") == "included_manifest"), "left_anti")
    return reach.join(open_, F.col("at") == F.col("path")).drop("at")
