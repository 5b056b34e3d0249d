"""JavaScript and TypeScript sources as rows of functions, classes, imports, calls and assignments, read by their tokens.

No compiler is needed: comments and texts are blanked out, brackets matched, and
what the rules ask about is found between them. Code inside template texts is code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.python_code import EVIDENCE, LONGEST_FUNCTION, SCHEMA, SMALL, WORST_COMPLEXITY
from quarrylight.sources.shared import spread

NAME = r"[A-Za-z_$][\w$]*"
#: What a scan stops at: comments, texts, starts of templates, slashes, names, numbers, brackets and other signs.
TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[`/(){}]|[A-Za-z_$][\w$]*|\d[\w.]*|\S", re.S)
#: A template's own text, up to its end or to code inside it.
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)
PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: An element of markup where a value may begin; its own end, or its closing tag, must follow. A tag's parts, and an element's text.
ELEMENT = re.compile(r"<(?:([A-Za-z][\w$.:-]*)(?=[\s/>])|(?=>))")
IN_TAG = re.compile(r"/\s*>|[>{]|\"[^\"]*\"?|'[^']*'?")
CHILDREN = re.compile(r"[^<{]*")
#: Behind these words, and behind the brackets of those, a slash begins a pattern.
BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
HEADS = frozenset("if while for with".split())
FUNCTION = re.compile(rf"\bfunction\b\s*\*?\s*({NAME})?\s*(?:<[^<>()]*>\s*)?\(")
ARROW = re.compile(r"=>\s*")
METHOD = re.compile(rf"(?<![.\w$])(?:(?:async|static|public|private|protected|get|set|readonly)\s+)*[*#]?\s*({NAME})\s*(?:<[^<>()]*>\s*)?\(")
CLASS = re.compile(rf"\b(abstract\s+)?class\b\s*({NAME})?[^{{}};()]*\{{|\binterface\s+({NAME})[^{{}};()]*\{{")
IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:([^;'\"`()]*?)\s*\bfrom\s*)?(?=[\"'])|\bexport\s+(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{[^{}]*\})\s*from\s*(?=[\"'])")
CALL = re.compile(rf"(\bnew\s+)?(?:\.\s*|\b)(eval|Function|exec|execSync|spawn|spawnSync|query|execute|raw)\s*\(")
SINK = re.compile(r"\.\s*(innerHTML|outerHTML)\s*=(?![=>])|(?<=[\s{])(dangerouslySetInnerHTML)\s*=(?![=>])")
BRANCH = re.compile(r"\b(?:if|for|while|catch|case)\b|&&|\|\||\?\?(?!=)|(?<!\?)\?(?![?.:])")
NOT_METHODS = frozenset("if for while switch catch function return with await typeof new super".split())
PAIRS = {")": "(", "]": "[", "}": "{"}
SQL = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "FROM", "WHERE")


def _gone(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def blanked(text: str) -> str:
    """The code alone: comments and patterns are spaces, texts keep their quotes around spaces, lines and places stay.

    A scan with a stack: a template whose text holds code becomes spaces, with each
    piece of its code in round brackets, so what stands there is seen as code, templates in it too. Markup keeps
    its tags and the code inside it, its texts become spaces. A slash begins a
    pattern where no value stands before it, and after the brackets of ``if`` and its like.
    """
    out, at = [], 0
    stack: list[str] = []  # open brackets: "(" or "head(" for those of a condition, "{", or "${" of code in a template
    value, word = False, ""  # whether a value stands before, and the last word if nothing stands behind it

    def template(i: int, inside: bool) -> int:
        """A template's text from ``i`` on; ``inside``: behind code in it."""
        nonlocal value
        m = TEMPLATE.match(text, i)
        body = _gone(text[i : m.start(1)])
        if m[1] == "${":
            out.append((body if inside else " " + body) + " (")
            if not inside:
                stack.append("${")
            value = False
        elif inside:
            stack.pop()
            out.append(body + _gone(m[1]))
            value = True
        else:
            out.append("`" + body + m[1])
            value = True
        return m.end()

    def is_element(i: int) -> bool:
        """Whether markup begins at ``i``, and no type in angle brackets."""
        m = ELEMENT.match(text, i)
        if m is None:
            return False
        end = re.compile(rf"</\s*{re.escape(m[1] or '')}\s*>").search(text, m.end())
        own = IN_TAG.search(text, m.end())
        while own and own[0][0] in "\"'":
            own = IN_TAG.search(text, own.end())
        return end is not None or bool(own and own[0][0] == "/")

    def markup(i: int) -> int:
        """Markup from ``i`` on, up to code inside it or its end: names of tags stay, texts are spaces."""
        nonlocal value
        while stack and stack[-1] in ("tag", "element"):
            if stack[-1] == "tag":
                m = IN_TAG.search(text, i)
                if m is None:
                    out.append(text[i:])
                    return len(text)
                out.append(text[i : m.start()])
                i = m.end()
                if m[0] == "{":
                    out.append("{")
                    stack.append("{m")
                    value = False
                    return i
                if m[0][0] in "\"'":
                    out.append(m[0][0] + _gone(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else " ")
                    continue
                out.append(m[0])
                stack.pop()
                if m[0] == ">":
                    stack.append("element")
                continue
            m = CHILDREN.match(text, i)
            out.append(_gone(m[0]))
            i = m.end()
            if i == len(text):
                return i
            if text[i] == "{":
                out.append("{")
                stack.append("{m")
                value = False
                return i + 1
            closing = re.compile(r"</\s*[\w$.:-]*\s*>").match(text, i)
            if closing:
                out.append(closing[0].replace("/", " "))
                stack.pop()
                i = closing.end()
            elif opening := ELEMENT.match(text, i):
                out.append(opening[0])
                stack.append("tag")
                i = opening.end()
            else:
                out.append(" ")
                i += 1
        value = True
        return i

    while m := TOKEN.search(text, at):
        out.append(text[at : m.start()])
        token, at, last, word = m[0], m.end(), word, ""
        if token.startswith(("//", "/*")):
            out.append(_gone(token))
            word = last
        elif token[0] in "\"'":
            out.append(token[0] + _gone(token[1:-1]) + token[-1] if len(token) > 1 else token)
            value = True
        elif token == "`":
            at = template(at, False)
        elif token == "/" and not value and (p := PATTERN.match(text, m.start())):
            out.append(_gone(p[0]))
            at, value = p.end(), True
        elif token == "<" and not value and is_element(m.start()):
            opening = ELEMENT.match(text, m.start())
            out.append(opening[0])
            stack.append("tag")
            at = markup(opening.end())
        elif token == "}" and stack and stack[-1] == "{m":
            stack.pop()
            out.append("}")
            at = markup(at)
        elif token in "({":
            stack.append("head(" if token == "(" and last in HEADS else token)
            out.append(token)
            value = False
        elif token == "}" and stack and stack[-1] == "${":
            out.append(")")
            at = template(at, True)
        elif token in ")}":
            opened = stack.pop() if stack else ""
            out.append(token)
            value = token == ")" and opened != "head("
        else:
            out.append(token)
            word = token if token[0].isalpha() or token[0] in "_$" else ""
            value = token in ")]" or (bool(word) and word not in BEFORE_PATTERN) or token[0].isdigit()
    out.append(text[at:])
    return "".join(out)


def matched(code: str) -> tuple[dict[int, int], int | None]:
    """Where each opening bracket is closed, and the place of the first that does not match."""
    closed, stack, quote = {}, [], ""
    for i, c in enumerate(code):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            stack.append(i)
        elif c in ")]}":
            if not stack or code[stack[-1]] != PAIRS[c]:
                return closed, i
            closed[stack.pop()] = i
    return closed, stack[-1] if stack else None


def _functions(code: str, closed: dict[int, int]) -> list[tuple[str, int, int, int]]:
    """(name, start, start of the body, end) of each function, arrow and method with a body."""
    found = {}

    def body(at: int) -> int | None:
        """The brace after a parameter list that closes at ``at``, past a result type."""
        m = re.compile(r"\s*(?::[^{};=]*?)?\s*\{").match(code, at + 1)
        return m.end() - 1 if m else None

    for m in FUNCTION.finditer(code):
        start = body(closed.get(m.end() - 1, len(code)))
        if start in closed:
            before = re.search(rf"({NAME})\s*[=:]\s*(?:async\s*)?$", code[max(0, m.start() - 80) : m.start()])
            found[start] = (m[1] or (before[1] if before else "anonymous"), m.start(), start, closed[start])
    for m in ARROW.finditer(code):
        opens = _opening(code, closed, m.start())
        head = re.search(rf"{NAME}\s*$", code[max(0, m.start() - 120) : m.start()])
        start = opens if opens is not None else m.start() - len(head[0]) if head else m.start()
        named = re.search(rf"({NAME})\s*(?::[^=;(){{}}]*)?[=:]\s*(?:async\s*)?$", code[max(0, start - 120) : start])
        if m.end() < len(code) and code[m.end()] == "{":
            end = closed.get(m.end())
        else:
            end, i = None, m.end()
            while i < len(code) and end is None:
                if i in closed:
                    i = closed[i]
                elif code[i] in ",;)]}" or (code[i] == "\n" and code[m.end() : i].strip()):
                    end = i - 1
                i += 1
            end = len(code) - 1 if end is None else end
        if end is not None:
            found[m.end()] = (named[1] if named else "anonymous", start, m.end(), end)
    for m in METHOD.finditer(code):
        if m[1] in NOT_METHODS or m.end() - 1 not in closed:
            continue
        start = body(closed[m.end() - 1])
        if start in closed and start not in found:
            found[start] = (m[1], m.start(1), start, closed[start])
    return sorted(found.values(), key=lambda f: (f[1], -f[3]))


def _opening(code: str, closed: dict[int, int], arrow: int) -> int | None:
    """Where the parameter list before an arrow opens."""
    at = len(code[:arrow].rstrip()) - 1
    if at >= 0 and code[at] == ")":
        return next((o for o in range(at - 1, max(-1, at - 2000), -1) if closed.get(o) == at), None)
    return None


def _complexity(code: str, own: tuple, functions: list[tuple]) -> int:
    text = code[own[2] : own[3] + 1]
    for f in functions:
        if f is not own and own[2] <= f[1] and f[3] <= own[3] and (f[2], f[3]) != (own[2], own[3]):
            text = text[: f[1] - own[2]] + " " * (f[3] + 1 - f[1]) + text[f[3] + 1 - own[2] :]
    return 1 + len(BRANCH.findall(text))


def _argument(text: str, code: str, start: int, end: int, closed: dict[int, int]) -> tuple[str, str]:
    """What a call's first argument is (str, mixed, name, other or none), and its text."""
    i = start
    while i < end and code[i] != ",":
        i = closed.get(i, i) + 1
    part, raw = code[start:i].strip(), text[start:i].strip()
    if not part:
        return "none", ""
    if raw[0] == "`" and part[0] != "`":  # a template with code in it
        return "mixed", raw
    if re.fullmatch(r"([\"'`])\s*\1", part):
        return "template" if raw[0] == "`" else "str", raw
    if re.search(r"\+(?!\+)", part):
        return "mixed", raw
    return ("name" if re.fullmatch(NAME, part) else "other"), raw


def _imports(text: str, code: str) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    for m in IMPORT.finditer(code):
        end = code.find(code[m.end()], m.end() + 1)
        module = text[m.end() + 1 : end]
        told = lambda name, alias="", is_from="true", module=module: (name, {"module": module, "alias": alias, "from": is_from})
        said = [told(module, is_from="false" if m[0].startswith("import") else "true")]
        if m[1]:
            said = []
            clause, braces, inside = m[1].partition("{")[0].strip(" ,\n"), "{" in m[1], re.search(r"\{([^}]*)\}", m[1])
            for part in filter(None, (x.strip() for x in clause.split(","))):
                said.append(told(re.sub(r"^\*\s*as\s+", "", part)))
            if braces and inside:
                for part in filter(None, (x.strip() for x in inside[1].split(","))):
                    name = part.split()[-1]
                    said.append(told(name, name if " as " in part else ""))
        for name, detail in said:
            yield m.start(), end, name, detail


def _facts(text: str) -> Iterator[tuple]:
    """(kind, name, start, end, value, detail, evidence) of one source, by places in the text."""
    code = blanked(text)
    closed, wrong = matched(code)
    if wrong is not None:
        yield "syntax_error", f"{code[wrong]} is not matched", wrong, wrong, 0, {}, None
        return
    yield "parsed", "", 0, max(0, len(text) - 1), 0, {}, None
    functions = _functions(code, closed)
    classes = []
    for m in CLASS.finditer(code):
        end = closed[m.end() - 1]
        inside = [f for f in functions if m.end() <= f[1] and f[3] < end and not any(m.end() <= g[1] < f[1] and f[3] <= g[3] for g in functions)]
        methods = len(inside) if m[3] is None else len(re.findall(rf"{NAME}\s*\(", code[m.end() : end]))
        classes.append(("class", m[2] or m[3] or "anonymous", m.start(), end, methods, {"abstract": str(bool(m[1] or m[3])).lower()}, None))
    yield from classes
    for f in functions:
        yield "function", f[0], f[1], f[3], _complexity(code, f, functions), {}, None
    for start, end, name, detail in _imports(text, code):
        yield "import", name, start, end, 0, detail, None
    snippet = lambda i, j: re.sub(r"[\r\n\t]+", " ", text[i : j + 1].strip())
    for m in CALL.finditer(code):
        start, end = m.end(), closed[m.end() - 1]
        kind, raw = _argument(text, code, start, end, closed)
        receiver = re.search(rf"({NAME})\s*$", code[max(0, m.start() - 60) : m.start()]) if m[0].lstrip().startswith(".") else None
        detail = {"argument": kind, "text": raw, "=shell": str(bool(re.search(r"\bshell\s*:\s*true\b", code[start:end]))).lower(), "new": str(bool(m[1])).lower()}
        if m[0].startswith("."):
            detail["on"] = receiver[1] if receiver else "?"
        at = m.start(1) if m[1] else receiver.start() + max(0, m.start() - 60) if receiver else m.start(2)
        yield "call", m[2], at, end, 0, detail, snippet(at, end)
    for m in SINK.finditer(code):
        line_end = text.find("\n", m.end())
        yield "assign", m[1] or m[2], m.start() + (m[0][0] == "."), m.end() - 1, 0, {}, snippet(text.rfind("\n", 0, m.start()) + 1, (len(text) if line_end < 0 else line_end) - 1)


def _rows(content: str) -> list[tuple]:
    """The rows of one source, without its path."""
    rows, starts = [], [0, *(m.end() for m in re.finditer("\n", content))]
    line = lambda at: bisect_right(starts, at)
    for kind, name, start, end, value, detail, evidence in _facts(content):
        n = line(start)
        told = evidence if evidence is not None else content[starts[n - 1] : starts[n] if n < len(starts) else None].strip()
        told = told if len(told) <= EVIDENCE else told[: EVIDENCE - 3] + "..."
        rows.append((kind, name, n, start - starts[n - 1] + 1, line(end), value, list(detail.items()), told, len(starts)))
    return rows


@lru_cache(maxsize=256)
def _known_rows(content: str) -> list[tuple]:
    return _rows(content)


def facts(sources: DataFrame) -> DataFrame:
    """(path, content) rows of scripts to rows of the form that ``python_code.facts`` has, with kind assign besides.

    Files are dealt to all cores, and a task reads files of one content once while it remembers them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                rows.extend((path, *r) for r in (_known_rows if len(content) <= SMALL else _rows)(content))
            columns = zip(*rows, strict=True) if rows else [()] * len(SCHEMA)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SCHEMA.names)

    return spread(sources.select("path", "content"), "path").mapInArrow(run, SCHEMA)


def findings(found: DataFrame) -> DataFrame:
    """rule_id, severity, confidence, path, line, column, end_line, evidence, total_lines of every match of a script rule."""
    name, detail = F.col("name"), F.col("detail")
    argument, plain = detail["argument"], ~F.map_contains_key("detail", "on")
    is_call, is_function = F.col("kind") == "call", F.col("kind") == "function"

    def hit(rule: str, when: Column, severity, confidence="HIGH") -> Column:
        lift = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(F.lit(rule).alias("rule_id"), lift(severity).alias("severity"), lift(confidence).alias("confidence")))

    literal, dynamic, fresh = argument == "str", argument.isin("mixed", "name"), detail["new"] == "true"
    commands, starters = name.isin("exec", "execSync"), name.isin("spawn", "spawnSync") & (detail["=shell"] == "true")
    says_sql = F.upper(detail["text"]).rlike("|".join(SQL))
    rules = F.array(
        hit("JS-SYNTAX-001", F.col("kind") == "syntax_error", "HIGH"),
        hit("JS-COMPLEXITY-001", is_function & (F.col("value") > WORST_COMPLEXITY), "MEDIUM"),
        hit("JS-FUNCTION-001", is_function & (F.col("end_line") - F.col("line") + 1 > LONGEST_FUNCTION), "LOW"),
        hit("JSSEC001", is_call & plain & ((name == "eval") & ~fresh | (name == "Function")), F.when(literal, "MEDIUM").otherwise("CRITICAL"), F.when(literal, "MEDIUM").otherwise("HIGH")),
        hit("JSSEC002", F.col("kind") == "assign", "HIGH", "MEDIUM"),
        hit("JSSEC003", is_call & ~fresh & (commands | starters), F.when(starters | dynamic, "HIGH").otherwise("MEDIUM"), F.when(starters | dynamic, "HIGH").otherwise("MEDIUM")),
        hit("JSSEC004", is_call & ~fresh & name.isin("query", "execute", "raw") & (argument == "mixed") & says_sql, "HIGH"),
    )
    place = ["path", "line", "column", "end_line", "evidence", "total_lines"]
    return found.select(*place, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.*", *place)
