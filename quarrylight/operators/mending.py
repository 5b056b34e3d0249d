"""Rewrites of findings: the parser's spans say what is changed, and nothing is offered that does not parse."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.sources import script_code

#: Characters of a shell command that are more than words between spaces.
SHELL = frozenset("'\"\\`$&|;<>()*?[]{}~#!\n%=")


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    text: str


class Source:
    """A text with places by line; lines count from 1, columns in bytes from 0, as the parser has them."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:column].decode(errors="ignore"))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def part(self, first: int, last: int) -> tuple[int, int]:
        """Where lines ``first`` to ``last`` stand, without the last one's newline."""
        return self.starts[first - 1], self.starts[min(last, len(self.lines))] - 1


def _called(node: ast.Call) -> tuple[str | None, str]:
    """The name that a call is made on, None for none and "?" for no plain name, and the called name."""
    f = node.func
    if isinstance(f, ast.Attribute):
        return (f.value.id if isinstance(f.value, ast.Name) else "?"), f.attr
    return None, f.id if isinstance(f, ast.Name) else ""


def _keyword(node: ast.Call, name: str) -> ast.keyword | None:
    return next((k for k in node.keywords if k.arg == name), None)


def _is(node: ast.AST | None, value: object) -> bool:
    return isinstance(node, ast.Constant) and node.value is value


def literal_eval(source: Source, calls: list[ast.Call]) -> list[Edit] | None:
    """``eval`` of one value becomes ``ast.literal_eval``; not beside ``exec``, nor with a namespace."""
    ours = [c for c in calls if _called(c) in ((None, "eval"), ("builtins", "eval"), ("__builtins__", "eval"))]
    if any(_called(c)[1] == "exec" for c in calls) or any(len(c.args) != 1 or c.keywords or isinstance(c.args[0], ast.Starred) for c in ours):
        return None
    return [Edit(*source.span(c.func), "ast.literal_eval") for c in ours]


def verified_tls(source: Source, calls: list[ast.Call]) -> list[Edit]:
    """Contexts and requests check certificates again."""
    edits = [Edit(*source.span(c.func), "ssl.create_default_context") for c in calls if _called(c) == ("ssl", "_create_unverified_context")]
    return edits + [Edit(*source.span(k), "verify=True") for c in calls if (k := _keyword(c, "verify")) and _is(k.value, False)]


def _weak(c: ast.Call) -> bool:
    return _called(c) in (("hashlib", "md5"), ("hashlib", "sha1"))


def sha256(source: Source, calls: list[ast.Call]) -> list[Edit]:
    """Broken hashes become SHA-256, by name or as the first argument of ``new``, which stays an argument."""
    edits = [Edit(*source.span(c.func), "hashlib.sha256") for c in calls if _weak(c)]
    for c in calls:
        if _called(c) == ("hashlib", "new") and c.args and isinstance(c.args[0], ast.Constant) and str(c.args[0].value).lower() in ("md5", "sha1"):
            a, b = source.span(c.args[0])
            edits.append(Edit(a, b, source.text[a] + "sha256" + source.text[b - 1] if source.text[a] in "'\"" else "'sha256'"))
    return edits


def not_for_security(source: Source, calls: list[ast.Call]) -> list[Edit]:
    """The hash stays and says that it guards nothing."""
    edits = []
    for c in calls:
        if _weak(c) and _keyword(c, "usedforsecurity") is None:
            last = max([source.span(x)[1] for x in (*c.args, *c.keywords)], default=None)
            at = source.span(c)[1] - 1 if last is None else last
            edits.append(Edit(at, at, "usedforsecurity=False" if last is None else ", usedforsecurity=False"))
    return edits


def _words(node: ast.AST) -> str | None:
    """A plain command as the text of a list; None where a shell would do more than part words."""
    text = node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""
    return repr(text.split()) if text.split() and not SHELL & set(text) else None


def argument_list(source: Source, calls: list[ast.Call]) -> list[Edit] | None:
    """Commands that are plain words run without a shell."""
    edits = []
    for c in calls:
        on, name = _called(c)
        if (on, name) == ("os", "system") and len(c.args) == 1:
            words = _words(c.args[0])
            edits.append(words and Edit(*source.span(c), f"subprocess.run({words}, check=True)"))
        elif on == "subprocess" and name in ("run", "call", "check_call", "check_output", "Popen") and (k := _keyword(c, "shell")) and _is(k.value, True) and c.args:
            words = _words(c.args[0])
            edits += [words and Edit(*source.span(c.args[0]), words), Edit(*source.span(k), "shell=False")]
    return edits if all(edits) else None


def json_parse(source: Source, first: int, last: int) -> list[Edit] | None:
    code = script_code.blanked(source.text)
    found = [m for m in script_code.CALL.finditer(code) if first <= m.start(2) < last and m[2] == "eval" and not m[0].lstrip().startswith(".")]
    return None if any(m[1] for m in found) else [Edit(m.start(2), m.end(2), "JSON.parse") for m in found]


def text_content(source: Source, first: int, last: int) -> list[Edit]:
    code = script_code.blanked(source.text)
    return [Edit(m.start(), m.end(), ".textContent =") for m in script_code.SINK.finditer(code) if m[1] == "innerHTML" and first <= m.start() < last]


# Strategies by the rule that they mend, in the order in which they are tried, with risk and confidence.
STRATEGIES: tuple[tuple[str, str, str, str, Callable], ...] = (
    ("FIX-PYSEC001-LITERAL-EVAL", "PYSEC001", "LOW", "HIGH", literal_eval),
    ("FIX-PYSEC005-RESTORE-TLS", "PYSEC005", "LOW", "HIGH", verified_tls),
    ("FIX-PYSEC004-HASH-SHA256", "PYSEC004", "MEDIUM", "HIGH", sha256),
    ("FIX-PYSEC004-NONSEC-FLAG", "PYSEC004", "LOW", "HIGH", not_for_security),
    ("FIX-PYSEC003-ARG-LIST", "PYSEC003", "MEDIUM", "MEDIUM", argument_list),
    ("FIX-JSSEC001-JSON-PARSE", "JSSEC001", "MEDIUM", "MEDIUM", json_parse),
    ("FIX-JSSEC002-TEXT-CONTENT", "JSSEC002", "LOW", "HIGH", text_content),
)
# Findings of vulnerable dependencies, and the strategy that raises a version.
DEPENDENCY_RULES = ("DEP_VULN", "DEPENDENCY_VULNERABILITY", "DEP001", "VULNERABLE_DEPENDENCY")
UPGRADE = ("FIX-DEP-UPGRADE-VERSION", "MEDIUM", "HIGH")

#: What each strategy can change for those who rely on the code.
RISKS = {
    "FIX-PYSEC001-LITERAL-EVAL": "Only literals are read from now on: texts that call functions, name variables or compute raise ValueError.",
    "FIX-PYSEC005-RESTORE-TLS": "Certificates are checked from now on: servers with self-signed, private or expired ones are refused until their roots are installed.",
    "FIX-PYSEC004-HASH-SHA256": "Digests become 64 hex digits: stored hashes, column widths and partners that expect the old length must follow.",
    "FIX-PYSEC004-NONSEC-FLAG": "The digest stays; the argument needs Python 3.9 or later.",
    "FIX-PYSEC003-ARG-LIST": "No shell runs from now on: pipes, redirections, wildcards and variables in the command are no longer expanded.",
    "FIX-JSSEC001-JSON-PARSE": "Only strict JSON is read from now on: single quotes, bare keys and expressions raise SyntaxError.",
    "FIX-JSSEC002-TEXT-CONTENT": "Markup in the value is shown as text from now on.",
    "FIX-DEP-UPGRADE-VERSION": "A later version may have changed or dropped interfaces; lock files must be made again and tests run.",
}


def risk_of(strategy: Column) -> Column:
    """What a strategy's patch may change; for unknown ones that a person must look."""
    told = F.create_map(*[F.lit(x) for pair in RISKS.items() for x in pair])
    return F.coalesce(told[strategy], F.lit("A person must say whether this fits the code around it."))


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


def _edited(source: Source, edits: list[Edit], first: int, last: int) -> str | None:
    """The lines from ``first`` to ``last`` (places) with the edits; None if one leaves them or two meet."""
    out, at = [], first
    for e in sorted(edits, key=lambda e: (e.start, e.end)):
        if e.start < at or e.end > last:
            return None
        out += [source.text[at : e.start], e.text]
        at = e.end
    return "".join([*out, source.text[at:last]])


def mended(content: str, rule: str, line: int, end_line: int, asked: str | None) -> tuple[str, str, str, str] | None:
    """(strategy, new lines, risk, sure) of the first strategy that changes the lines of a finding and leaves a text that parses."""
    source = Source(content)
    first, last = source.part(line, end_line)
    tried = [s for s in STRATEGIES if s[1] == rule and asked in (None, s[0])]
    calls: list[ast.Call] = []
    if tried and rule.startswith("PY"):
        try:
            calls = [n for n in ast.walk(ast.parse(content)) if isinstance(n, ast.Call) and line <= n.lineno and n.end_lineno <= end_line]
        except (SyntaxError, ValueError, RecursionError):
            return None
    for name, _, risk, sure, change in tried:
        edits = change(source, calls) if rule.startswith("PY") else change(source, first, last)
        new = _edited(source, edits, first, last) if edits else None
        if new is None or new == source.text[first:last]:
            continue
        whole = content[:first] + new + content[last:]
        if _parses(whole) if rule.startswith("PY") else script_code.matched(script_code.blanked(whole))[1] is None:
            return name, new, risk, sure
    return None


def proposed(rows: DataFrame, content: str, asked: Column) -> DataFrame:
    """``rows`` (rule_id, line, end_line and others) with remediation_id, new, risk, sure; the column ``content`` goes."""
    told = rows.withColumn("__asked", asked)
    kept = [f for f in rows.schema.fields if f.name != content]
    schema = T.StructType([*kept, *[T.StructField(n, T.StringType()) for n in ("remediation_id", "new", "risk", "sure")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in (content, "rule_id", "line", "end_line", "__asked")]
            found = []
            for text, rule, line, end, wish in zip(*columns, strict=True):
                text, rule, line, end = text.as_py(), rule.as_py(), line.as_py(), end.as_py()
                inside = text is not None and rule is not None and line is not None and 1 <= line <= text.count("\n") + 1
                found.append((mended(text, rule, line, max(line, end or line), wish.as_py()) if inside else None) or (None,) * 4)
            new = [pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else [()] * 4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *new], names=[f.name for f in schema.fields])

    return told.mapInArrow(run, schema)
