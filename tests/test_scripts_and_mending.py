"""Generated scripts and Python with planted calls: what is found, where templates and patterns end, and that repairs parse."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import mending, remediation
from quarrylight.sources import python_code, script_code


def found(text):
    return [(kind, name, text[start:end + 1]) for kind, name, start, end, *_ in script_code._facts(text) if kind in ("call", "assign", "syntax_error")]


@pytest.mark.parametrize("text, want", [
    ("a = `x ${eval(y)} z`;", ["eval"]),
    ("a = `x ${b ? `n ${eval(y)} m` : `eval(no)`} ${exec(`rm ${z}`)}`; eval(1)", ["eval", "exec", "eval"]),
    ("a = `eval(no) \\${eval(no)} \\` eval(no)`;", []),
    ("a = `${ {k: '}', j: `}`} } eval(no)`; eval(q)", ["eval"]),
    ("a = `one\ntwo ${f(`three\n${eval(x)}`)}\n`;\neval(y)", ["eval", "eval"]),
    ("if (a) /eval(/.test(b); eval(c)", ["eval"]),
    ("x = (a) / eval(b) / c", ["eval"]),
    ("x = a[1] / eval(b) / c; y = 4 / eval(d) / 2", ["eval", "eval"]),
    ("return /[/\\]'\"]/.exec(s) || eval(t)", ["exec", "eval"]),
    ("x = y /* / */ / eval(b) /1; // eval(no)", ["eval"]),
    ("while (x) /'/.test(y); eval('z')", ["eval"]),
    ("const f = () => `${`${`${eval(1)}`}`}`", ["eval"]),
    ("s = 'it`s'; eval(x); t = \"`\"; eval(y)", ["eval", "eval"]),
    ("open = `never ${eval(x)}", ["eval"]),
    ("a = <p>don't {eval(x)} it's</p>; eval(y)", ["eval", "eval"]),
    ("return <div dangerouslySetInnerHTML={{__html: q}} title=\"eval(no)\">eval(no) {f(`${eval(z)}`)}</div>", ["eval"]),
    ("f = <T,>(x: T) => x; if (a < b) { eval(c) } // d>", ["eval"]),
    ("f = <T extends U>(x: T) => eval(x)", ["eval"]),
    ("y = <><A b={eval(1)} c='/'/><B>{a ? <C>it's {eval(2)}</C> : null}</B></>; eval(3)", ["eval", "eval", "eval"]),
    ("z = (<div>\n  {list.map(i => <li key={i}>can't</li>)}\n</div>); eval(r)", ["eval"]),
    ("m = new Map<string, number>(); <br/>; eval(x)", ["eval"]),
])
def test_templates_and_patterns(text, want):
    code = script_code.blanked(text)
    assert len(code) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
    assert [m[2] for m in script_code.CALL.finditer(code)] == want


def test_random_scripts():
    """Scripts put together from parts with a known number of calls; the scan finds just those, and no bracket is left over."""
    rng = random.Random(4)

    def expression(depth):
        """(text, calls) of an expression."""
        if depth == 0:
            return rng.choice([("x", 0), ("12", 0), ("'eval(no)'", 0), ('"`${eval(no)}"', 0), ("`eval(no)`", 0), ("/eval\\(`[/}]/g", 0)])
        kind = rng.randrange(6)
        (a, n), (b, m) = expression(depth - 1), expression(depth - 1)
        if kind == 0:
            return f"eval({a})", n + 1
        if kind == 1:
            return f"`t{{ ${{{a}}} }} ' ${{ {b} }}`", n + m
        if kind == 2:
            return f"({a}) / ({b})", n + m
        if kind == 3:
            return f"[{a}, /* ` eval(no) */ {b}]", n + m
        if kind == 4:
            return f"f({{k: {a}}})", n
        return f"({a} ? {b} : 0)", n + m

    for _ in range(400):
        parts = [expression(rng.randrange(5)) for _ in range(3)]
        text = "\n".join(f"v = {t}; // `eval(no)" for t, _ in parts)
        facts = found(text)
        assert sum(k == "call" and n == "eval" for k, n, _ in facts) == sum(n for _, n in parts), text
        assert not any(k == "syntax_error" for k, *_ in facts), text


CASES = [
    ("PYSEC004", "h = hashlib.new('md5', b)", "h = hashlib.new('sha256', b)"), ("PYSEC004", "h = hashlib.new(\"SHA1\")", "h = hashlib.new(\"sha256\")"), ("PYSEC004", "h = hashlib.sha1(f(a, b)).hexdigest()", "h = hashlib.sha256(f(a, b)).hexdigest()"),
    ("PYSEC001", "m.eval(q); eval(q)", "m.eval(q); ast.literal_eval(q)"), ("PYSEC001", "x = 'eval(a)' + eval(b)", "x = 'eval(a)' + ast.literal_eval(b)"), ("PYSEC001", "eval(a, b)", None), ("PYSEC001", "eval(*a)", None), ("PYSEC001", "é = 'ü'; eval(é)", "é = 'ü'; ast.literal_eval(é)"),
    ("PYSEC005", "requests.get(u, verify = False, timeout=3)", "requests.get(u, verify=True, timeout=3)"), ("PYSEC005", "f(verify=False); s = 'verify=False'", "f(verify=True); s = 'verify=False'"),
    ("PYSEC003", "subprocess.run('ls -l', cwd=d, shell=True)", "subprocess.run(['ls', '-l'], cwd=d, shell=False)"), ("PYSEC003", "os.system('ls > x')", None), ("PYSEC003", "subprocess.run(c, shell=True)", None), ("PYSEC003", "os.system('a b') or os.system(c)", None),
    ("JSSEC002", "if (el.innerHTML == a) b();", None), ("JSSEC002", "el.innerHTML = a === b;", "el.textContent = a === b;"), ("JSSEC002", "s = 'x.innerHTML = 1';", None), ("JSSEC002", "`${el.innerHTML = q}`", "`${el.textContent = q}`"),
    ("JSSEC001", "x.eval(a); eval(b)", "x.eval(a); JSON.parse(b)"), ("JSSEC001", "s = 'eval(a)'", None), ("JSSEC001", "new Function('a')", None),
]


@pytest.mark.parametrize("rule, line, want", CASES)
def test_mended(rule, line, want):
    got = mending.mended(f"first\n{line}\nlast", rule, 2, 2, None)
    assert (got and got[1]) == want
    if rule.startswith("PY"):
        assert got is None or ast.parse(got[1])
    assert mending.mended(line, "OTHER", 1, 1, None) is None


def test_asked_and_several_lines():
    text = "import hashlib\nh = hashlib.md5(\n    b,\n)\n"
    assert mending.mended(text, "PYSEC004", 2, 4, "FIX-PYSEC004-NONSEC-FLAG")[:2] == ("FIX-PYSEC004-NONSEC-FLAG", "h = hashlib.md5(\n    b, usedforsecurity=False,\n)")
    assert mending.mended("hashlib.md5()", "PYSEC004", 1, 1, "FIX-PYSEC004-NONSEC-FLAG")[1] == "hashlib.md5(usedforsecurity=False)"
    assert mending.mended(text, "PYSEC004", 2, 2, None) is None and mending.mended(text, "PYSEC004", 2, 4, "none") is None
    assert mending.mended("x = (", "PYSEC001", 1, 1, None) is None


def test_random_python_repairs(spark):
    """Files with planted calls: each is found, and each repair that is offered parses, removes its finding and adds none."""
    rng = random.Random(8)
    lines = ["x = eval(q)", "requests.get(u, verify=False)", "h = hashlib.md5(b)", "h = hashlib.new('sha1', b)", "os.system('ls -l')", "subprocess.call('a b', shell=True)", "exec(q)", "ok = 1", "s = 'eval(x)'", "hashlib.sha1()", "eval(q, {})"]
    files = []
    for i in range(60):
        body = ["import ast, hashlib, os, requests, subprocess"]
        for _ in range(rng.randrange(8)):
            body.append(rng.choice(["", "if a:\n    ", "for é in b:\n    "]) + rng.choice(lines))
        files.append((f"f{i}.py", "\n".join(body) + "\n"))
    sources = spark.createDataFrame(files, "path string, content string")
    findings = python_code.findings(python_code.facts(sources)).filter("rule_id LIKE 'PYSEC%'")
    made = remediation.proposed(findings, sources).collect()
    assert len(made) > 100 and sum(r["remediation_id"] is not None for r in made) > 60
    text, patched = dict(files), []
    for n, r in enumerate(made):
        if r["new"] is not None:
            body = text[r["path"]].split("\n")
            body[r["line"] - 1 : r["end_line"]] = r["new"].split("\n")
            ast.parse("\n".join(body))
            patched.append((f"{n}/{r['path']}", "\n".join(body), r["rule_id"], r["line"], r["remediation_id"]))
    again = python_code.findings(python_code.facts(spark.createDataFrame([p[:2] for p in patched], "path string, content string"))).select("path", "rule_id", "line").collect()
    hit = {(r["path"], r["rule_id"], r["line"]) for r in again}
    assert not [p for p in patched if (p[0], p[2], p[3]) in hit]


def test_upgrade_is_a_strategy(spark):
    findings = spark.createDataFrame([("requirements.txt", "DEP_VULN", 1, 1, "lib", "2.0"), ("requirements.txt", "DEP001", 1, 1, "none", "3"), ("a.py", "PYSEC001", 1, 1, None, None), ("x", None, None, None, None, None)], "path string, rule_id string, line int, end_line int, package string, remediation string")
    sources = spark.createDataFrame([("requirements.txt", "a==1\nlib==1.0 # why\n"), ("a.py", "eval(x)")], "path string, content string")
    got = {(r["path"], r["rule_id"]): (r["line"], r["remediation_id"], r["new"], r["risk"]) for r in remediation.proposed(findings, sources).collect()}
    assert got[("requirements.txt", "DEP_VULN")] == (2, "FIX-DEP-UPGRADE-VERSION", "lib>=2.0 # why", "MEDIUM")
    assert got[("requirements.txt", "DEP001")] == (1, None, None, None) and got[("x", None)] == (None, None, None, None)
    assert got[("a.py", "PYSEC001")][1] == "FIX-PYSEC001-LITERAL-EVAL"
    assert set(mending.RISKS) == {s[0] for s in mending.STRATEGIES} | {mending.UPGRADE[0]}
    assert remediation.proposed(findings, sources, F.lit("FIX-PYSEC005-RESTORE-TLS")).filter("remediation_id IS NOT NULL").count() == 0


def test_sources_of_one_small_file_are_dealt_to_all_cores(spark):
    """A table in one partition is parsed by many tasks, and equal sources keep their own paths."""
    from pyspark.sql import functions as F

    from quarrylight.sources import python_code, script_code

    for facts, text in ((python_code.facts, "def f(a):\n    return a\n"), (script_code.facts, "function f(a) {\n  return a;\n}\n")):
        files = spark.range(0, 600, 1, 1).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 2 == 0, text).otherwise(F.concat(F.lit(text), F.lit("\n"))).alias("content"))
        found = facts(files).filter("kind = 'function'").withColumn("task", F.spark_partition_id()).collect()
        assert len({r["task"] for r in found}) > 4
        assert {(r["path"], r["name"], r["line"], r["total_lines"]) for r in found} == {(str(i), "f", 1, text.count("\n") + 1 + i % 2) for i in range(600)}
