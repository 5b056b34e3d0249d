"""Queries on source files: what they are, what is found in them, and how they are cut and mended.

The tables hold no code, so files are made from their rows: row k of ``part`` becomes
the file that template k mod n makes, and the SQL knows what each template must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import files as fl
from quarrylight.functions import text as tx
from quarrylight.functions import urls
from quarrylight.operators import answers, chunking, embedding, mending, metrics, remediation
from quarrylight.plans.registry import query, table, values
from quarrylight.sources import archives, discovery, manifests, python_code, script_code


def picked(column: str, options: list[str]) -> Column:
    """The option that a row's number picks."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.col(column) % len(options) + 1).cast("int"))


# --- files -------------------------------------------------------------------------------------

#: name, language, category, is_source, known binary, secret, ignored
NAMES = [
    ("src/Dockerfile", "Dockerfile", "source", True, False, False, False), ("a/b.d.ts", "TypeScript", "source", True, False, False, False), ("a/x.test.tsx", "TypeScript", "source", True, False, False, False),
    ("a/x.spec.jsx", "JavaScript", "source", True, False, False, False), ("README", "Text", "documentation", False, False, False, False), ("README.MD", "Markdown", "documentation", False, False, False, False),
    ("img/photo.PNG", "PNG Image", "other", False, True, False, False), ("x/data.tar.gz", "Archive", "other", False, True, False, False), (".env", "Unknown", "other", False, False, True, False),
    (".env.local", "Unknown", "other", False, False, True, False), ("keys/Server.PEM", "Unknown", "other", False, False, True, False), ("node_modules/a/index.js", "JavaScript", "source", True, False, False, True),
    ("a/dist", "Unknown", "other", False, False, False, False), ("dist/a.py", "Python", "source", True, False, False, True), ("v/a.blade.php", "PHP", "source", True, False, False, False), ("m/m.gql", "GraphQL", "source", True, False, False, False),
    ("c/client_secrets_1.json", "JSON", "configuration", False, False, True, False), ("t/x.parquet", "Parquet", "data", False, True, False, False), ("t/noend.", "Unknown", "other", False, False, False, False), ("t/.py", "Unknown", "other", False, False, False, False),
    ("CMakeLists.txt", "CMake", "configuration", False, False, False, False), ("k/id_rsa", "Unknown", "other", False, False, True, False), ("k/a.C", "C", "source", True, False, False, False), ("k/a.lock", "Unknown", "other", False, False, False, False),
]
_NAMES = values([(i, *n) for i, n in enumerate(NAMES)], "i, path, language, category, is_source, known_binary, secret, ignored")


@query(f"SELECT page_id, path, language, category, is_source, known_binary, secret, ignored FROM pages JOIN (SELECT * FROM {_NAMES}) n ON page_id % {len(NAMES)} = i")
def file_languages(spark, d):
    """Every page under a file's name: its language and kind by that name alone."""
    p = F.col("path")
    rows = table(spark, d, "pages").select("page_id", picked("page_id", [n[0] for n in NAMES]).alias("path"), fl.language(picked("page_id", [n[0] for n in NAMES])).alias("k"))
    return rows.select("page_id", "path", "k.*", fl.known_binary(p).alias("known_binary"), fl.secret(p).alias("secret"), fl.ignored(p).alias("ignored"))


_HEAD = "regexp_extract_all(substr(hex(body), 1, 16384), '..')"
_FILES = f"""
WITH b AS (SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'src/app/' WHEN 3 THEN 'docs/' ELSE '' END || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.json' ELSE '.pem' END AS path,
  encode(CASE WHEN doc_id % 7 = 3 THEN text || chr(1) || '\\x00' ELSE text END) AS body, CASE WHEN doc_id % 7 = 3 THEN text || chr(1) || '\\x00' ELSE text END AS text FROM documents),
f AS (SELECT *, CASE WHEN path LIKE '%.png' THEN true WHEN strlen(text) = 0 THEN false
  ELSE len(list_filter({_HEAD}, lambda x: NOT (x BETWEEN '20' AND '7E' OR x IN ('0A', '0D', '09', '08')))) / len({_HEAD}) > 0.3 END AS is_binary FROM b WHERE path NOT LIKE 'node_modules/%'),
d AS (SELECT path, CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.md' THEN 'Markdown' WHEN path LIKE '%.png' THEN 'PNG Image' WHEN path LIKE '%.json' THEN 'JSON' ELSE 'Unknown' END AS language,
  CASE WHEN path LIKE '%.py' THEN 'source' WHEN path LIKE '%.md' THEN 'documentation' WHEN path LIKE '%.json' THEN 'configuration' ELSE 'other' END AS category,
  path LIKE '%.py' AND NOT is_binary AS is_source, strlen(text)::BIGINT AS size, is_binary,
  CASE WHEN NOT is_binary AND path NOT LIKE '%.pem' THEN CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END END::INT AS line_count, sha256(body) AS sha256 FROM f)
"""


def _made_files(spark, d) -> DataFrame:
    k = F.col("doc_id")
    folder = F.when(k % 10 == 1, "node_modules/").when(k % 10 == 2, "src/app/").when(k % 10 == 3, "docs/").otherwise("")
    text = F.when(k % 7 == 3, F.concat("text", F.lit("\x01\\x00"))).otherwise(F.col("text"))
    path = F.concat(folder, k.cast("string"), picked("doc_id", [".py", ".md", ".png", ".json", ".pem"]))
    return table(spark, d, "documents").select(path.alias("path"), text.cast("binary").alias("content"), F.octet_length(text).cast("long").alias("size"))


@query(_FILES + "SELECT * FROM d")
def discovered_files(spark, d):
    """Every document as a file: what it is, whether it is binary, its lines and its hash."""
    rows = discovery.discovered(_made_files(spark, d))
    return rows.select("path", "language", "category", "is_source", "size", "is_binary", F.col("line_count").cast("int").alias("line_count"), "sha256")


@query(_FILES + "SELECT count(*) AS files, count(*) FILTER (is_source) AS source_files, sum(size)::BIGINT AS bytes, sum(coalesce(line_count, 0))::BIGINT AS lines FROM d")
def inventory_totals(spark, d):
    return metrics.totals(discovery.discovered(_made_files(spark, d)), "size", "line_count", "is_source")


@query(_FILES + "SELECT category, count(*) AS files, sum(size)::BIGINT AS bytes, sum(coalesce(line_count, 0))::BIGINT AS lines FROM d GROUP BY 1")
def category_distribution(spark, d):
    return metrics.ordered(metrics.totals_by(discovery.discovered(_made_files(spark, d)), "category", "size", "line_count"), "category")


@query(_FILES + "SELECT split_part(path, '/', 1) AS owner, count(*) AS files, sum(size)::BIGINT AS bytes, CASE WHEN count(*) > 60 THEN 'too_many_files' WHEN sum(size) > 50000 THEN 'too_many_bytes' END AS refused FROM d GROUP BY 1")
def repository_limits(spark, d):
    return discovery.refused(discovery.discovered(_made_files(spark, d)), F.split_part("path", F.lit("/"), F.lit(1)), 60, 50_000)


@query(_FILES + "SELECT path, CASE WHEN size <= 2000 THEN md5((SELECT decode(body) FROM f WHERE f.path = d.path)) END AS text_md5, size > 2000 AS truncated, size % 4 = 0 AS drifted FROM d WHERE NOT is_binary AND path NOT LIKE '%.pem'")
def readable_files(spark, d):
    """Texts as analysis reads them; every fourth size is expected with another hash."""
    found = _made_files(spark, d)
    rows = discovery.discovered(found)
    expected = rows.select("path", F.when(F.col("size") % 4 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return discovery.readable(rows, found, expected, 2000).select("path", F.md5("text").alias("text_md5"), "truncated", "drifted")


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')) AS w FROM documents), u AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT doc_id, n, ('0x' || substr(sha256(w), 1, 8))::BIGINT AS h FROM u), v AS (SELECT doc_id, (h % 64)::INT AS bucket, sum(CASE WHEN (h >> 1) & 1 = 0 THEN n ELSE -n END)::DOUBLE AS x FROM h GROUP BY ALL),
s AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1) SELECT doc_id, bucket, round(CASE WHEN norm > 1e-9 THEN x / norm ELSE x END, 6) AS value FROM v JOIN s USING (doc_id)""")
def hash_embedding(spark, d):
    """Feature-hash vectors at unit length, a row per bucket."""
    return embedding.hash_buckets(table(spark, d, "documents"), ["doc_id"], "text", 64)


# --- addresses and archives -----------------------------------------------------------------------

URLS = [
    ("https://git.example/own/repo", None, "own", "repo"), ("https://www.git.example/own/repo.git", None, "own", "repo"), ("http://git.example/own/repo", "scheme", None, None), ("https://u:p@git.example/own/repo", "credentials", None, None),
    ("https://other.example/own/repo", "host", None, None), ("https://git.example:8443/own/repo", "port", None, None), ("https://git.example:443/own/Repo.js/", None, "own", "Repo.js"), ("https://git.example/own", "path", None, None),
    ("https://git.example/own/repo/tree", "path", None, None), ("https://git.example/-own/repo", "owner", None, None), ("https://git.example/own/re po", "name", None, None), ("  ", "empty", None, None), ("https://git.example/own/..", "name", None, None),
]


@query(f"SELECT page_id, url, problem, owner, name, CASE WHEN problem IS NULL THEN lower('git.example:' || owner || '/' || name) END AS identifier FROM (SELECT page_id FROM pages) p JOIN (SELECT * FROM {values([(i, *u) for i, u in enumerate(URLS)], 'i, url, problem, owner, name')}) u ON page_id % {len(URLS)} = i")
def repository_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", picked("page_id", [u[0] for u in URLS]).alias("url"))
    return rows.select("page_id", "url", urls.repository(F.col("url"), ("git.example", "www.git.example")).alias("r")).select("page_id", "url", "r.*")


HOSTS = [
    ("localhost", True), ("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("192.168.9.9", True), ("8.8.8.8", False), ("169.254.1.1", True), ("0.0.0.0", True), ("224.0.0.1", True), ("255.255.255.255", True),
    ("::1", True), ("[::1]", True), ("fe80::1", True), ("fd00::1", True), ("2606:4700::1", False), ("64:ff9b::10.0.0.1", True), ("64:ff9b::8.8.8.8", False), ("64:ff9b::0a00:0001", True), ("example.com", False), ("256.1.1.1", False), ("ff02::1", True),
]


@query(f"SELECT c_custkey, host, inside FROM customer JOIN (SELECT * FROM {values([(i, *h) for i, h in enumerate(HOSTS)], 'i, host, inside')}) h ON c_custkey % {len(HOSTS)} = i")
def inner_addresses(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", picked("c_custkey", [h[0] for h in HOSTS]).alias("host"))
    return rows.withColumn("inside", urls.inner_address(F.col("host")))


MEMBERS = [
    ("root/a.py", "file", None, 1000, "root/a.py", "ok"), ("root/./b//c.py", "file", None, 20, "root/b/c.py", "ok"), ("/abs.py", "file", None, 5, "abs.py", "ok"), ("root/../../x", "file", None, 5, "root/../../x", "escapes"), ("C:\\x", "file", None, 5, "C:/x", "escapes"),
    ("root/l1", "link", "a.py", 0, "root/l1", "ok"), ("root/l2", "link", "../../etc", 0, "root/l2", "skip"), ("root/l3", "link", "/etc", 0, "root/l3", "skip"), ("root/big", "file", None, 2000000, "root/big", "too_large"), ("", "file", None, 1, None, "skip"),
    ("//host/x", "file", None, 1, "host/x", "escapes"), ("root/d", "directory", None, 0, "root/d", "ok"),
]
_MEMBERS = values([(i, *m) for i, m in enumerate(MEMBERS)], "i, member, kind, link, size, path, verdict")


def _members(spark, d) -> DataFrame:
    rows = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("archive"), (F.col("p_partkey") % len(MEMBERS)).alias("i"), F.col("p_size").cast("long").alias("archive_bytes"), "p_partkey")
    made = spark.createDataFrame([(i, m[0], m[1], m[2], m[3]) for i, m in enumerate(MEMBERS)], "i long, member string, kind string, link string, size long")
    named = F.when(F.col("i").isin(0, 1), F.concat("member", F.col("p_partkey").cast("string"))).otherwise(F.col("member"))
    return rows.join(F.broadcast(made), "i").select("archive", "archive_bytes", named.alias("member"), "kind", "link", "size")


_MADE = f"WITH m AS (SELECT p_partkey % 50 AS archive, p_size::BIGINT AS archive_bytes, member || CASE WHEN i < 2 THEN p_partkey::VARCHAR ELSE '' END AS member, kind, link, size, path || CASE WHEN i < 2 THEN p_partkey::VARCHAR ELSE '' END AS path, verdict FROM part JOIN (SELECT * FROM {_MEMBERS}) t ON p_partkey % {len(MEMBERS)} = i)"


@query(_MADE + " SELECT archive, member, path, verdict FROM m")
def archive_members(spark, d):
    return archives.judged(_members(spark, d))


@query(_MADE + """, s AS (SELECT archive, max(archive_bytes) AS packed, count(*) FILTER (kind = 'file') AS files, coalesce(sum(size) FILTER (kind = 'file'), 0)::BIGINT AS bytes, min(verdict) FILTER (verdict IN ('escapes', 'too_large')) AS bad FROM m GROUP BY 1)
SELECT archive, files, bytes, CASE WHEN bad IS NOT NULL THEN bad WHEN files > 10000 THEN 'too_many_files' WHEN bytes > 157286400 THEN 'too_many_bytes' WHEN bytes > 1048576 AND bytes / packed > 10 THEN 'expands_too_much' END AS refused FROM s""")
def archive_limits(spark, d):
    return archives.admitted(_members(spark, d))


@query(_MADE + " SELECT archive, CASE WHEN min(split_part(path, '/', 1)) = max(split_part(path, '/', 1)) AND bool_or(contains(path, '/')) THEN min(split_part(path, '/', 1)) END AS root FROM m WHERE verdict = 'ok' AND kind <> 'link' GROUP BY 1")
def archive_roots(spark, d):
    """The one folder that holds all that may be unpacked of an archive, links aside."""
    return archives.single_root(archives.judged(_members(spark, d).filter("kind <> 'link'")))


# --- findings ------------------------------------------------------------------------------------

#: code, and what it must give: (rule, severity, confidence, line)
PYTHON = [
    ("import os\nos.system(q)\nos.system('ls')\n", [("PYSEC003", "HIGH", "HIGH", 2), ("PYSEC003", "MEDIUM", "MEDIUM", 3)]),
    ("eval(q)\neval('1')\nbuiltins.exec(q)\nmodel.eval()\n", [("PYSEC001", "HIGH", "HIGH", 1), ("PYSEC001", "MEDIUM", "MEDIUM", 2), ("PYSEC001", "HIGH", "HIGH", 3)]),
    ("import pickle as p\nfrom _pickle import loads as ld\np.loads(b)\nld(b)\np.load(b'x')\npickle.open(b)\nimport shelve\nshelve.open(f)\n", [("PYSEC002", "CRITICAL", "HIGH", 3), ("PYSEC002", "CRITICAL", "HIGH", 4), ("PYSEC002", "HIGH", "MEDIUM", 5), ("PYSEC002", "CRITICAL", "HIGH", 8)]),
    ("import json\njson.loads(b)\nloads(b)\ncPickle.loads(b)\nshelve.loads(b)\n", []),
    ("import subprocess\nsubprocess.run(q, shell=True)\nsubprocess.run([q])\nsubprocess.call('x', shell=1)\nsubprocess.Popen(q, shell=False)\n", [("PYSEC003", "HIGH", "HIGH", 2), ("PYSEC003", "MEDIUM", "MEDIUM", 4)]),
    ("import hashlib\nfrom hashlib import sha1\nhashlib.md5(b)\nhashlib.new('MD5')\nsha1(b)\nmd5(b)\nhashlib.sha1(b, usedforsecurity=False)\nhashlib.sha256(b)\n", [("PYSEC004", "MEDIUM", "MEDIUM", 3), ("PYSEC004", "MEDIUM", "MEDIUM", 4), ("PYSEC004", "MEDIUM", "MEDIUM", 5), ("PYSEC004", "INFO", "LOW", 7)]),
    ("import ssl\nrequests.get(u, verify=False)\nget(u, verify=False)\nrequests.get(u, verify=True)\nssl._create_unverified_context()\nother(u, verify=False)\n", [("PYSEC005", "HIGH", "HIGH", 2), ("PYSEC005", "HIGH", "HIGH", 3), ("PYSEC005", "HIGH", "HIGH", 5)]),
    ("c.execute(f'select {q}')\nc.execute('select ' + q)\nc.raw(q % 1)\nc.execute('select 1')\nexecute(f'select {q}')\nc.execute('drop {}'.format(q))\nc.execute(f'select')\n", [("PYSEC006", "HIGH", "HIGH", 1), ("PYSEC006", "HIGH", "HIGH", 2), ("PYSEC006", "MEDIUM", "MEDIUM", 3), ("PYSEC006", "HIGH", "HIGH", 6)]),
    ("import os\nimport os\nfrom a import b\nfrom a import b as c\nfrom a import b\n", [("PY-IMPORT-001", "LOW", "HIGH", 2), ("PY-IMPORT-001", "LOW", "HIGH", 5)]),
    ("def f(a):\n" + "".join(f"    if a and b or {i}: pass\n" for i in range(4)), [("PY-COMPLEXITY-001", "MEDIUM", "HIGH", 1)]),
    ("def g(a):\n    x = [i for i in a if i if i > 1]\n    y = 1 if a else 2 if a else 3\n    with a: assert a\n    try: pass\n    except E: pass\n    while a: pass\n    for i in a: pass\n    if a: pass\n", []),
    ("def h():\n" + "    pass\n" * 50, [("PY-FUNCTION-001", "LOW", "HIGH", 1)]),
    ("x = 1\ndef (:\n", [("PY-SYNTAX-001", "HIGH", "HIGH", 2)]),
]
_FOUND = values([(i, *r) for i, (_, rows) in enumerate(PYTHON) for r in rows], "i, rule_id, severity, confidence, line")
_PATH = "'pkg' || p_size || '/m' || p_partkey || '.py'"


def python_files(spark, d) -> DataFrame:
    path = F.concat(F.lit("pkg"), F.col("p_size").cast("string"), F.lit("/m"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return table(spark, d, "part").select(path.alias("path"), picked("p_partkey", [c for c, _ in PYTHON]).alias("content"))


_CODES = values([(i, c) for i, (c, _) in enumerate(PYTHON)], "i, code")
_PY = f"WITH f AS (SELECT {_PATH} AS path, i, code, string_split(code, chr(10)) AS lines FROM part JOIN (SELECT * FROM {_CODES}) t ON p_partkey % {len(PYTHON)} = i), r AS (SELECT path, rule_id, severity, confidence, line, trim(lines[line]) AS evidence, sha256(rule_id || ':' || path || ':' || line || ':' || trim(lines[line])) AS fingerprint FROM f JOIN (SELECT * FROM {_FOUND}) x USING (i))"


@query(_PY + " SELECT rule_id, severity, confidence, path, line::INT AS line, evidence, fingerprint FROM r")
def ast_findings(spark, d):
    """Every Python rule on code that is made of the table's rows, made canonical, with evidence and fingerprints."""
    found = python_code.normalised(python_code.findings(python_code.facts(python_files(spark, d))))
    return found.select("rule_id", "severity", "confidence", "path", "line", "evidence", "fingerprint")


@query(_PY + """, n AS (SELECT rule_id, (row_number() OVER (ORDER BY rule_id) - 1)::INT AS rule_index FROM (SELECT DISTINCT rule_id FROM r))
SELECT path, line::INT AS line, rule_id, rule_index, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, evidence AS message, path AS uri, line::INT AS start_line, fingerprint FROM r JOIN n USING (rule_id)""")
def sarif_results(spark, d):
    """SARIF results, read back from the JSON that they are."""
    found = python_code.normalised(python_code.findings(python_code.facts(python_files(spark, d))))
    place = "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
    said = F.from_json("result", f"ruleId string, ruleIndex int, level string, message struct<text:string>, {place}, properties struct<fingerprint:string>")
    read = python_code.sarif(found).select("path", "line", said.alias("r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return read.select("path", "line", F.col("r.ruleId").alias("rule_id"), F.col("r.ruleIndex").alias("rule_index"), "r.level", F.col("r.message.text").alias("message"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"), "r.properties.fingerprint")


@query(_PY + " SELECT split_part(path, '/', 1) AS owner, count(*) AS results, (SELECT count(DISTINCT rule_id) FROM r) AS rules FROM r GROUP BY 1")
def sarif_logs(spark, d):
    """A whole SARIF log for each folder: how many results and rules it holds."""
    found = python_code.normalised(python_code.findings(python_code.facts(python_files(spark, d))))
    logs = python_code.sarif_report(found, F.split_part("path", F.lit("/"), F.lit(1)))
    said = F.from_json("report", "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string>>>>")
    return logs.select("owner", F.size(said["runs"][0]["results"]).cast("long").alias("results"), F.size(said["runs"][0]["tool"]["driver"]["rules"]).cast("long").alias("rules"))


#: Line 1 of template 9 has this complexity, of template 10 that.
_FACTS = [(9, "f", 13, 5), (10, "g", 10, 9), (11, "h", 1, 51)]


@query(f"SELECT {_PATH} AS path, name, complexity::INT AS complexity, lines::INT AS lines FROM part JOIN (SELECT * FROM {values(_FACTS, 'i, name, complexity, lines')}) t ON p_partkey % {len(PYTHON)} = i")
def python_functions(spark, d):
    found = python_code.facts(python_files(spark, d)).filter("kind = 'function'")
    return found.select("path", "name", F.col("value").alias("complexity"), (F.col("end_line") - F.col("line") + 1).alias("lines"))


CLASSES = [
    ("from abc import ABC\nclass A(ABC):\n    def m(self): pass\n", "A", True, 1), ("import abc\nclass B(abc.ABC, C): pass\n", "B", True, 0), ("class P(typing.Protocol):\n    x: int\n", "P", True, 0),
    ("class D:\n    @abstractmethod\n    def m(self): pass\n    @abc.abstractmethod\n    async def n(self): pass\n", "D", True, 2), ("class E(D):\n    def m(self): pass\n    x = lambda: 1\n", "E", False, 1),
]


@query(f"SELECT p_partkey, name, abstract, methods::INT AS methods FROM part JOIN (SELECT * FROM {values([(i, *c[1:]) for i, c in enumerate(CLASSES)], 'i, name, abstract, methods')}) t ON p_partkey % {len(CLASSES)} = i")
def python_classes(spark, d):
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), picked("p_partkey", [c[0] for c in CLASSES]).alias("content"))
    found = python_code.facts(files).filter("kind = 'class'")
    return found.select(F.col("path").cast("long").alias("p_partkey"), "name", (F.col("detail")["abstract"] == "true").alias("abstract"), F.col("value").alias("methods"))


SCRIPT = [
    ("eval(a);\neval('1');\nnew Function(a);\nx.eval(a);\nconst e = \"eval(a)\"; // eval(a)\n", [("JSSEC001", "CRITICAL", "HIGH", 1), ("JSSEC001", "MEDIUM", "MEDIUM", 2), ("JSSEC001", "CRITICAL", "HIGH", 3)]),
    ("el.innerHTML = a;\nel.outerHTML=b;\nif (el.innerHTML == a) {}\nvar x = <p dangerouslySetInnerHTML={{__html: a}} />;\n", [("JSSEC002", "HIGH", "MEDIUM", 1), ("JSSEC002", "HIGH", "MEDIUM", 2), ("JSSEC002", "HIGH", "MEDIUM", 4)]),
    ("exec(`ls ${a}`);\ncp.execSync('ls');\nspawn('ls', { shell: true });\nspawn('ls', { shell: false });\nexec(cmd);\n", [("JSSEC003", "HIGH", "HIGH", 1), ("JSSEC003", "MEDIUM", "MEDIUM", 2), ("JSSEC003", "HIGH", "HIGH", 3), ("JSSEC003", "HIGH", "HIGH", 5)]),
    ("db.query(`SELECT ${a}`);\ndb.execute('DELETE ' + a);\ndb.query('SELECT 1');\ndb.query(`hello ${a}`);\nraw(sql);\n", [("JSSEC004", "HIGH", "HIGH", 1), ("JSSEC004", "HIGH", "HIGH", 2)]),
    ("const f = (a) => {\n" + "  if (a && b || c) { a = a ? 1 : 2; }\n" * 3 + "};\n", [("JS-COMPLEXITY-001", "MEDIUM", "HIGH", 1)]),
    ("function g(a) {\n" + "  go();\n" * 50 + "}\n", [("JS-FUNCTION-001", "LOW", "HIGH", 1)]),
    ("function h( {\n", [("JS-SYNTAX-001", "HIGH", "HIGH", 1)]),
    ("import a from './a';\nfunction k(x) { return x?.y ?? 1; }\n", []),
]
_SFOUND = values([(i, *r) for i, (_, rows) in enumerate(SCRIPT) for r in rows], "i, rule_id, severity, confidence, line")


@query(f"SELECT p_partkey, rule_id, severity, confidence, line::INT AS line FROM part JOIN (SELECT * FROM {_SFOUND}) t ON p_partkey % {len(SCRIPT)} = i")
def script_findings(spark, d):
    """Every rule of scripts on code that is made of the table's rows."""
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), picked("p_partkey", [c for c, _ in SCRIPT]).alias("content"))
    found = script_code.findings(script_code.facts(files))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "rule_id", "severity", "confidence", "line")


LANGUAGES = [("Python", 10, "PY-COMPLEXITY-001"), ("TypeScript", 7, "JS-COMPLEXITY-001"), ("jsx", 7, "JS-COMPLEXITY-001"), ("Go", 0, None)]


@query(f"SELECT p_partkey, language, n::INT AS rules, least_id FROM part JOIN (SELECT * FROM {values([(i, *x) for i, x in enumerate(LANGUAGES)], 'i, language, n, least_id')}) t ON p_partkey % {len(LANGUAGES)} = i")
def rule_registry(spark, d):
    """Which rules a file's language has."""
    rows = table(spark, d, "part").select("p_partkey", picked("p_partkey", [x[0] for x in LANGUAGES]).alias("language"))
    own = python_code.rules_for(F.col("language"))
    return rows.select("p_partkey", "language", F.size(own).alias("rules"), F.array_min(own).alias("least_id"))


DRAFTS = [("./a//b/../c.py", 0, None, 5, 0, "see C:\\Users\\x\\y now"), ("/x.py", 9, 2, 5, None, "plain"), ("x\\y.py", 3, 99, 5, 3, "d:/tmp/q 'z'"), ("z.py", 4, 6, 0, 1, "")]


@query(f"""SELECT p_partkey, path, line::INT AS line, column_ AS "column", end_line::INT AS end_line, evidence, sha256('R:' || path || ':' || line || ':' || evidence) AS fingerprint FROM part JOIN (SELECT * FROM {values([(0, 'a/b/c.py', 1, 1, None, 'see <sanitized-path> now'), (1, 'x.py', 5, 1, 5, 'plain'), (2, 'x/y.py', 3, 3, 5, "<sanitized-path> 'z'"), (3, 'z.py', 4, 1, 6, '')], 'i, path, line, column_, end_line, evidence')}) t ON p_partkey % 4 = i""")
def normalised_drafts(spark, d):
    """Findings as rules first give them: wild paths, lines outside the file, paths of a machine in the evidence."""
    made = spark.createDataFrame([(i, *x) for i, x in enumerate(DRAFTS)], "i long, path string, line int, end_line int, total_lines int, column int, evidence string")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(DRAFTS)).alias("i")).join(F.broadcast(made), "i")
    told = python_code.normalised(rows.select(F.concat(F.lit("R"), F.lit("")).alias("rule_id"), F.col("p_partkey").cast("string").alias("severity"), F.lit("HIGH").alias("confidence"), "path", "line", "column", "end_line", "evidence", "total_lines"))
    return told.select(F.col("severity").cast("long").alias("p_partkey"), "path", "line", "column", "end_line", "evidence", "fingerprint")


# --- chunks --------------------------------------------------------------------------------------

CHUNKED = [
    ("m.py", "Python", "import a\nfrom b import c\n\nclass K:\n    def m(self):\n        pass\n\ndef f():\n    return 1\n", [("import", None, 1, 2), ("class", "K", 4, 6), ("function", "m", 5, 6), ("function", "f", 8, 9)]),
    ("m.py", "Python", "def (:\nx\n", [("window", None, 1, 3)]),
    ("m.ts", "TypeScript", "import a from 'b';\nfunction f(x) {\n  return x;\n}\n", [("import", None, 1, 1), ("function", "f", 2, 4)]),
    ("m.md", "Markdown", "before\n# One\nbody\n## Two x\n", [("section", "One", 2, 3), ("section", "Two x", 4, 5)]),
    ("m.txt", "Plain Text", "no heading\nat all", [("window", None, 1, 2)]),
    ("m.go", "Go", "\n".join(f"line {i}" for i in range(1, 101)), [("window", None, 1, 50), ("window", None, 46, 95), ("window", None, 91, 100)]),
    ("m.go", "Go", " \n\t\n", []),
]


@query(f"""WITH t AS (SELECT * FROM {values([(i, n, c) for i, (n, _, c, _) in enumerate(CHUNKED)], 'i, name, content')}), e AS (SELECT * FROM {values([(i, k, *r) for i, x in enumerate(CHUNKED) for k, r in enumerate(x[3])], 'i, chunk_index, kind, symbol, a, b')})
SELECT p_partkey || '/' || name AS path, chunk_index::INT AS chunk_index, kind, symbol, a::INT AS start_line, b::INT AS end_line, sha256(array_to_string(string_split(content, chr(10))[a:b], chr(10))) AS content_hash FROM part JOIN t ON p_partkey % {len(CHUNKED)} = t.i JOIN e ON e.i = t.i""")
def chunk_files(spark, d):
    """Files of all kinds, each cut in its own way."""
    made = spark.createDataFrame([(i, n, lang, c) for i, (n, lang, c, _) in enumerate(CHUNKED)], "i long, name string, language string, content string")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(CHUNKED)).alias("i")).join(F.broadcast(made), "i")
    cut = chunking.chunk_files(rows.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "name").alias("path"), "language", "content"))
    return cut.select("path", "chunk_index", "kind", "symbol", "start_line", "end_line", "content_hash")


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE regexp_matches(text, '\\S')),
w AS (SELECT doc_id, s, len(s) AS n, unnest(range(0, 1 + ceil(greatest(len(s) - 50, 0) / 45.0)::BIGINT)) AS i FROM l),
c AS (SELECT doc_id, i, 1 + 45 * i AS a, s[1 + 45 * i : 50 + 45 * i] AS x FROM w WHERE regexp_matches(array_to_string(s[1 + 45 * i : 50 + 45 * i], chr(10)), '\\S')),
f AS (SELECT doc_id, i, a, x, 1 AS line, strlen(x[1]) + 1 AS size, 1 AS part FROM c UNION ALL
  SELECT doc_id, i, a, x, line + 1, CASE WHEN size + strlen(x[line + 1]) + 1 > 8192 THEN strlen(x[line + 1]) + 1 ELSE size + strlen(x[line + 1]) + 1 END, CASE WHEN size + strlen(x[line + 1]) + 1 > 8192 THEN part + 1 ELSE part END FROM f WHERE line < len(x)),
p AS (SELECT doc_id, i, a, CASE WHEN strlen(array_to_string(any_value(x), chr(10))) <= 8192 THEN 0 ELSE part END AS part, min(line) AS f, max(line) AS t FROM f GROUP BY doc_id, i, a, part),
q AS (SELECT doc_id, i, a, part, min(f) AS f, max(t) AS t FROM p GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, f) - 1)::INT AS chunk_index, nullif(part, 0)::INT AS part, (a + f - 1)::INT AS start_line, (a + t - 1)::INT AS end_line FROM q""")
def chunk_documents(spark, d):
    """All documents as files without symbols: windows, cut further where they are long."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("language"), F.col("text").alias("content"))
    return chunking.chunk_files(rows, most=None).select(F.col("path").cast("long").alias("doc_id"), "chunk_index", "part", "start_line", "end_line")


_SPANS = values([(i, k, *r) for i, x in enumerate(CHUNKED) for k, r in enumerate(x[3])], "i, chunk_index, kind, symbol, a, b")


@query(f"""WITH t AS (SELECT * FROM {values([(i, n, c) for i, (n, _, c, _) in enumerate(CHUNKED)], 'i, name, content')}), e AS (SELECT * FROM {_SPANS}),
c AS (SELECT p_partkey || '/' || name AS path, chunk_index::INT AS chunk_index, a, b, array_to_string(string_split(content, chr(10))[a:b], chr(10)) AS x FROM part JOIN t ON p_partkey % {len(CHUNKED)} = t.i JOIN e ON e.i = t.i WHERE p_partkey % 3 <> 0),
w AS (SELECT path, chunk_index, unnest(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM c), h AS (SELECT path, chunk_index, ('0x' || substr(sha256(w), 1, 8))::BIGINT AS h FROM w), v AS (SELECT path, chunk_index, h % 8 AS k, sum(CASE WHEN (h >> 1) & 1 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL),
n AS (SELECT path, chunk_index, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL), f AS (SELECT path, chunk_index, round(sum(abs(round(CASE WHEN norm > 1e-9 THEN x / norm ELSE x END, 6))), 4) AS weight FROM v JOIN n USING (path, chunk_index) GROUP BY ALL)
SELECT path, chunk_index, sha256('s1:' || path || ':' || a || ':' || b || ':' || sha256(x)) AS fingerprint, coalesce(weight, 0) AS weight FROM c LEFT JOIN f USING (path, chunk_index)""")
def index_run(spark, d):
    """The index of those files, without binary and secret ones: fingerprints, and the weight of each vector."""
    made = spark.createDataFrame([(i, n, lang, c) for i, (n, lang, c, _) in enumerate(CHUNKED)], "i long, name string, language string, content string")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(CHUNKED)).alias("i")).join(F.broadcast(made), "i")
    path = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 6 == 3, F.lit(".env")).otherwise(F.col("name")))
    chunks = chunking.index_run(rows.select(path.alias("path"), "language", (F.col("p_partkey") % 6 == 0).alias("is_binary"), "content"), "s1", 8)
    weight = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x))
    return chunks.select("path", "chunk_index", "fingerprint", F.round(weight, 4).alias("weight"))


TREE = "import a, { b as c } from './x';\nclass K extends L {\n  constructor() { super(); }\n  go(n) { while (n) { n--; } }\n}\ninterface I { f(): void; }\nconst arrow = async (x) => { return x && 1; };\nexport * from './y';\n"
_TREE = [("class", "K", 2, 5, 2), ("class", "I", 6, 6, 1), ("function", "constructor", 3, 3, 1), ("function", "go", 4, 4, 2), ("function", "arrow", 7, 7, 2), ("import", "a", 1, 1, 0), ("import", "c", 1, 1, 0), ("import", "./y", 8, 8, 0)]


@query(f"SELECT p_partkey, kind, name, a::INT AS line, b::INT AS end_line, n::INT AS value FROM part, (SELECT * FROM {values(_TREE, 'kind, name, a, b, n')}) t")
def script_facts(spark, d):
    """Functions with their complexity, classes with their methods, and imports of a script for each row."""
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit(TREE).alias("content"))
    found = script_code.facts(files).filter("kind IN ('function', 'class', 'import')")
    return found.select(F.col("path").cast("long").alias("p_partkey"), "kind", "name", "line", "end_line", "value")


@query("SELECT user_id, array_to_string(list_filter(list(event_type ORDER BY event_id), lambda x: x IN ('view', 'click')), ' ') AS kept FROM events GROUP BY 1")
def valid_citations(spark, d):
    """Of what an answer cites, in order and with repeats, what the evidence has."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("cited"))
    return rows.select("user_id", F.array_join(answers.cited(F.col("cited"), F.array(F.lit("view"), F.lit("click"))), " ").alias("kept"))


# --- manifests -----------------------------------------------------------------------------------

MANIFESTS = [
    ("requirements.txt", "My_Lib==1.2  # pinned\n-r dev.txt\nother >=2,<3 ; python_version < '3'\n-e git+https://x/y#egg=Zed\nhttps://a.b/c/pkg.tar.gz\n--index-url x\nlong[a,b] \\\n ~=1.4\n", [
        ("pypi", "my-lib", "==1.2", "1.2", "direct", True, None, "resolved", 1), ("pypi", "dev-txt", "/dev.txt", None, "included_manifest", None, None, "unresolved_inclusion", 2), ("pypi", "other", "<3,>=2", None, "direct", True, "python_version < '3'", "unresolved", 3),
        ("pypi", "zed", None, None, "direct", None, None, "unsupported_editable", 4), ("pypi", "pkg", None, None, "direct", None, None, "unresolved_url", 5), ("pypi", "long", "~=1.4", None, "direct", True, None, "unresolved", 7)]),
    ("requirements-dev.txt", "pytest===8.0\nbad line here\n", [("pypi", "pytest", "===8.0", None, "direct", True, None, "unresolved", 1), ("pypi", None, "bad line here", None, "error", None, None, "error", 2)]),
    ("pyproject.toml", '[project]\ndependencies = ["a>=1", "b==2.0"]\n[project.optional-dependencies]\nx = ["c"]\n[tool.poetry.dependencies]\npython = "^3"\nd = "==4.1"\ne = {version = "^5", optional = true}\n[tool.poetry.group.dev.dependencies]\nf = "*"\n[tool.poetry.group.docs.dependencies]\ng = "1"\n', [
        ("pypi", "a", ">=1", None, "direct", True, None, "unresolved", None), ("pypi", "b", "==2.0", "2.0", "direct", True, None, "resolved", None), ("pypi", "c", None, None, "optional", True, "extra:x", "unresolved", None),
        ("pypi", "d", "==4.1", "4.1", "direct", True, "main", "resolved", None), ("pypi", "e", "^5", None, "optional", True, "main", "unresolved", None), ("pypi", "f", "*", None, "dev", True, "group:dev", "unresolved", None), ("pypi", "g", "1", None, "optional", True, "group:docs", "unresolved", None)]),
    ("poetry.lock", '[[package]]\nname = "A_b"\nversion = "1.0"\n[[package]]\nname = "c"\nversion = "2"\ncategory = "dev"\n[[package]]\nname = "d"\nversion = "3"\noptional = true\n', [
        ("pypi", "a-b", None, "1.0", "direct", None, "main", "resolved", None), ("pypi", "c", None, "2", "dev", None, "dev", "resolved", None), ("pypi", "d", None, "3", "optional", None, "main", "resolved", None)]),
    ("Pipfile.lock", '{"default": {"a": {"version": "==1.0"}, "b": {}}, "develop": {"c": {"version": "==2.0"}}}', [
        ("pypi", "a", "==1.0", "1.0", "direct", True, "default", "resolved", None), ("pypi", "b", None, None, "direct", True, "default", "unresolved", None), ("pypi", "c", "==2.0", "2.0", "dev", True, "develop", "resolved", None)]),
    ("package.json", '{\n "dependencies": {\n  "Left": "^1.0.0"},\n "devDependencies": {"x": "1.2.3"},\n "peerDependencies": {"p": ">=1"}\n}', [
        ("npm", "left", "^1.0.0", None, "direct", True, "production", "unresolved", 3), ("npm", "x", "1.2.3", None, "dev", True, "development", "unresolved", None), ("npm", "p", ">=1", None, "peer", True, "peer", "unresolved", None)]),
    ("package-lock.json", '{"packages": {"": {"dependencies": {"left": "1"}, "devDependencies": {"d": "1"}}, "node_modules/left": {"version": "1.0.4"}, "node_modules/d": {"version": "2.0.0", "dev": true}, "node_modules/left/node_modules/@s/n": {"version": "3.0.0"}}}', [
        ("npm", "left", None, "1.0.4", "direct", True, "production", "resolved", None), ("npm", "d", None, "2.0.0", "dev", True, "development", "resolved", None), ("npm", "@s/n", None, "3.0.0", "transitive", False, "production", "resolved", None)]),
    ("package-lock.json", '{"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0", "dev": true}}}}}', [
        ("npm", "a", None, "1.0.0", "direct", True, "production", "resolved", None), ("npm", "b", None, "2.0.0", "transitive", False, "development", "resolved", None)]),
    ("yarn.lock", '# v1\n\n"@s/x@^3.0.0", "@s/x@3":\n  version "3.1.0"\n', [("npm", "@s/x", None, "3.1.0", "direct", None, "production", "resolved", None)]),
    ("yarn.lock", "__metadata:\n  version: 6\n", [(None, None, None, None, "error", None, None, "error", None)]),
    ("pnpm-lock.yaml", "importers:\n  .:\n    dependencies: {left: 1.0.0}\n    devDependencies: {'@s/x': 2.0.0}\npackages:\n  /left@1.0.0: {}\n  '@s/x@2.0.0(left@1.0.0)': {}\n  /deep/3.1.0_left@1.0.0: {dev: true}\n", [
        ("npm", "left", None, "1.0.0", "direct", True, "production", "resolved", None), ("npm", "@s/x", None, "2.0.0", "dev", True, "development", "resolved", None), ("npm", "deep", None, "3.1.0", "transitive", False, "development", "resolved", None)]),
    ("notes.md", "text", []),
]
_COLUMNS = "i, ecosystem, package, c, resolved, kind, is_direct, scope, status, line"


def _manifests(spark, d) -> DataFrame:
    made = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(MANIFESTS)], "i long, name string, content string")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(MANIFESTS)).alias("i")).join(F.broadcast(made), "i")
    return rows.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "name").alias("path"), "content")


@query(f"""SELECT p_partkey || '/' || name AS path, ecosystem, package, CASE WHEN kind = 'included_manifest' THEN p_partkey || c ELSE c END AS "constraint", resolved, kind, is_direct::BOOLEAN AS is_direct, scope, status, line::INT AS line FROM part JOIN (SELECT * FROM {values([(i, n) for i, (n, _, _) in enumerate(MANIFESTS)], 'i, name')}) n ON p_partkey % {len(MANIFESTS)} = n.i JOIN (SELECT * FROM {values([(i, *r) for i, x in enumerate(MANIFESTS) for r in x[2]], _COLUMNS)}) e ON e.i = n.i""")
def manifest_inventory(spark, d):
    """Manifests and lock files of all kinds, one for each row of the table."""
    return manifests.inventory(_manifests(spark, d))


_COUNTED = [(e, sum(1 for x in MANIFESTS for r in x[2] if r[0] == e)) for e in ("pypi", "npm")]


@query(f"""WITH r AS (SELECT e.* FROM part JOIN (SELECT * FROM {values([(i, *r) for i, x in enumerate(MANIFESTS) for r in x[2]], _COLUMNS)}) e ON p_partkey % {len(MANIFESTS)} = e.i)
SELECT ecosystem, count(*) AS n, count(*) FILTER (coalesce(resolved, '') <> '') AS resolved, count(*) FILTER (coalesce(resolved, '') = '') AS unresolved, count(*) FILTER (coalesce(is_direct::BOOLEAN, false)) AS direct, count(*) FILTER (NOT coalesce(is_direct::BOOLEAN, false)) AS transitive FROM r GROUP BY 1""")
def dependency_counters(spark, d):
    return metrics.dependency_counts(manifests.inventory(_manifests(spark, d)))


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS k, p_partkey // 8 AS g FROM part), link AS (SELECT a.k AS k, b.k AS into_ FROM f a JOIN f b ON a.g = b.g AND b.k % 8 = (a.k % 8) * 2 % 8),
reach AS (SELECT k AS root, k AS n, 0 AS depth FROM f UNION SELECT root, into_, depth + 1 FROM reach JOIN link ON reach.n = link.k WHERE depth < 5), p AS (SELECT DISTINCT root, n FROM reach)
SELECT 'requirements-' || root || '.txt' AS root, 'requirements-' || n || '.txt' AS path, 'lib-' || n AS package FROM p""")
def requirement_inclusions(spark, d):
    """Files that name other files, some in circles: what each leads to."""
    k = F.col("p_partkey")
    other = F.floor(k / 8) * 8 + (k % 8) * 2 % 8
    name = lambda n: F.concat(F.lit("requirements-"), n.cast("long").cast("string"), F.lit(".txt"))
    exists = table(spark, d, "part").select(F.col("p_partkey").alias("__k"))
    rows = table(spark, d, "part").join(exists, other == F.col("__k"), "left")
    content = F.concat(F.lit("lib-"), k.cast("string"), F.lit("==1\n"), F.when(F.col("__k").isNotNull(), F.concat(F.lit("-r "), name(other), F.lit("\n"))).otherwise(""))
    found = manifests.included(manifests.inventory(rows.select(name(k).alias("path"), content.alias("content"))))
    return found.select("root", "path", "package")


# --- repairs -------------------------------------------------------------------------------------

#: file name, code, (rule, line, strategy or None, new line)
MENDED = [
    ("a.py", "import ast\nx = builtins.eval(q)\n", ("PYSEC001", 2, "FIX-PYSEC001-LITERAL-EVAL", "x = ast.literal_eval(q)")), ("a.py", "exec(q); eval(q)\n", ("PYSEC001", 1, None, None)),
    ("a.py", "requests.get(u, verify = False)\n", ("PYSEC005", 1, "FIX-PYSEC005-RESTORE-TLS", "requests.get(u, verify=True)")), ("a.py", "c = ssl._create_unverified_context()\n", ("PYSEC005", 1, "FIX-PYSEC005-RESTORE-TLS", "c = ssl.create_default_context()")),
    ("a.py", "import hashlib\nh = hashlib.md5(b)\n", ("PYSEC004", 2, "FIX-PYSEC004-HASH-SHA256", "h = hashlib.sha256(b)")), ("a.py", "subprocess.run('ls -l', shell=True)\n", ("PYSEC003", 1, "FIX-PYSEC003-ARG-LIST", "subprocess.run(['ls', '-l'], shell=False)")),
    ("a.py", "os.system(\"ls  -l\")\n", ("PYSEC003", 1, "FIX-PYSEC003-ARG-LIST", "subprocess.run(['ls', '-l'], check=True)")), ("a.py", "os.system(cmd)\n", ("PYSEC003", 1, None, None)), ("a.js", "let v = eval(t);\n", ("JSSEC001", 1, "FIX-JSSEC001-JSON-PARSE", "let v = JSON.parse(t);")),
    ("a.js", "el.innerHTML  = t;\n", ("JSSEC002", 1, "FIX-JSSEC002-TEXT-CONTENT", "el.textContent = t;")), ("a.py", "pickle.loads(b)\n", ("PYSEC002", 1, None, None)), ("a.py", "x = 1\n", ("PYSEC001", 9, None, None)),
    ("a.py", "import hashlib\nh = hashlib.new('MD5', b)\n", ("PYSEC004", 2, "FIX-PYSEC004-HASH-SHA256", "h = hashlib.new('sha256', b)")), ("a.py", "import ast\nm.eval(q); eval(q)\n", ("PYSEC001", 2, "FIX-PYSEC001-LITERAL-EVAL", "m.eval(q); ast.literal_eval(q)")),
    ("a.js", "if (el.innerHTML == a) go();\n", ("JSSEC002", 1, None, None)), ("a.py", "x = eval(q, {})\n", ("PYSEC001", 1, None, None)), ("a.py", "os.system('ls | wc')\n", ("PYSEC003", 1, None, None)),
]


def _mended(spark, d) -> DataFrame:
    made = spark.createDataFrame([(i, n, c, *r[:2]) for i, (n, c, r) in enumerate(MENDED)], "i long, name string, content string, rule_id string, line int")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(MENDED)).alias("i")).join(F.broadcast(made), "i")
    return rows.withColumn("path", F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "name")).withColumn("end_line", F.col("line"))


@query(f"""SELECT p_partkey, rule_id, line::INT AS line, remediation_id, "new", string_split(content, chr(10))[line] AS original FROM part JOIN (SELECT * FROM {values([(i, c, *r) for i, (n, c, r) in enumerate(MENDED)], 'i, content, rule_id, line, remediation_id, "new"')}) t ON p_partkey % {len(MENDED)} = i""")
def fix_strategies(spark, d):
    """The first strategy that mends each finding's line."""
    rows = _mended(spark, d)
    made = remediation.proposed(rows.select("path", "rule_id", "line", "end_line", "p_partkey"), rows.select("path", "content"))
    return made.select("p_partkey", "rule_id", "line", "remediation_id", "new", "original")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'CHK-01-INTEGRITY:FAILED' WHEN p_partkey % 5 = 2 THEN 'CHK-01-INTEGRITY:PASSED CHK-02-STRUCTURE:FAILED' WHEN p_partkey % 5 = 3 THEN 'CHK-01-INTEGRITY:PASSED CHK-02-STRUCTURE:PASSED CHK-03-SYNTAX:FAILED'
  WHEN p_partkey % 5 = 4 THEN 'CHK-01-INTEGRITY:PASSED CHK-02-STRUCTURE:PASSED CHK-03-SYNTAX:PASSED CHK-04-RULE-RECHECK:FAILED' ELSE 'CHK-01-INTEGRITY:PASSED CHK-02-STRUCTURE:PASSED CHK-03-SYNTAX:PASSED CHK-04-RULE-RECHECK:PASSED CHK-05-REGRESSION-RISK:PASSED' END AS checks, p_partkey % 5 = 0 AS valid, CASE WHEN p_partkey % 5 = 0 THEN told END AS told
FROM part JOIN (SELECT * FROM {values([(i, r[2], mending.RISKS.get(r[2])) for i, (n, c, r) in enumerate(MENDED)], 'i, remediation_id, told')}) t ON p_partkey % {len(MENDED)} = i WHERE remediation_id IS NOT NULL""")
def patch_checks(spark, d):
    """What the checks say of those patches: of five, one is right, and each of the others fails one check; and what a right one may change."""
    rows = _mended(spark, d)
    made = remediation.proposed(rows.select("path", "rule_id", "line", "end_line", "p_partkey", "content"), rows.select("path", "content")).filter("remediation_id IS NOT NULL")
    k = F.col("p_partkey") % 5
    new = F.when(k == 3, F.lit("(((")).when(k == 4, F.col("original")).otherwise(F.col("new"))
    after = remediation.replaced_lines(F.col("content"), F.col("line"), F.col("line"), F.col("__new"))
    made = made.withColumn("__new", new)
    proposals = made.select(
        F.col("p_partkey").alias("proposal_id"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), "end_line", "original", F.col("__new").alias("new"), "rule_id", "remediation_id",
        F.when(k == 1, F.lit("other")).otherwise(F.sha2("content", 256)).alias("original_hash"), F.when(k == 2, F.lit("other")).otherwise(F.sha2(after, 256)).alias("target_hash"),
    )
    told = remediation.checked(proposals, rows.select("path", "content"))
    return told.select(F.col("proposal_id").alias("p_partkey"), F.array_join(F.transform("checks", lambda c: F.concat(c["check_id"], F.lit(":"), c["state"])), " ").alias("checks"), "valid", F.array_max(F.transform("checks", lambda c: c["told"])).alias("told"))


UPGRADES = [("requirements.txt", "x==1\nMy.Lib==1.0  # pinned\n", "My.Lib", "2.0", 2, "My.Lib>=2.0  # pinned"), ("requirements.txt", "mylibrary==1\n", "mylib", "2.0", None, None), ("package.json", '{"dependencies": {\n  "left": "^1.0.0",\n  "b": "1"}}', "left", "1.3.0", 2, '  "left": "^1.3.0",'), ("package.json", '{\n"b": "1"}', "b", "2.0.0", 2, '"b": "2.0.0"}')]


@query(f"""SELECT p_partkey, package, line::INT AS line, "new" FROM part JOIN (SELECT * FROM {values([(i, u[2], u[4], u[5]) for i, u in enumerate(UPGRADES)], 'i, package, line, "new"')}) t ON p_partkey % {len(UPGRADES)} = i WHERE line IS NOT NULL""")
def dependency_upgrades(spark, d):
    made = spark.createDataFrame([(i, *u[:4]) for i, u in enumerate(UPGRADES)], "i long, name string, content string, package string, remediation string")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(UPGRADES)).alias("i")).join(F.broadcast(made), "i").withColumn("path", F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "name"))
    found = remediation.upgraded(rows.select("path", "package", "remediation"), rows.select("path", "content"))
    return found.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("p_partkey"), "package", "line", "new")


# --- texts ---------------------------------------------------------------------------------------

LOGS = [("password: hunter2, next", "password=******, next"), ("url https://u:pw@h/x", "url https://u:******@h/x"), ("Bearer abc.def-1 tail", "Bearer ****** tail"), ("plain words", "plain words"), ("api_key='k1' token=t2", "api_key=****** token=******")]


@query(f"SELECT event_id, masked FROM events JOIN (SELECT * FROM {values([(i, m) for i, (_, m) in enumerate(LOGS)], 'i, masked')}) t ON event_id % {len(LOGS)} = i")
def masked_logs(spark, d):
    return table(spark, d, "events").select("event_id", tx.masked(picked("event_id", [x for x, _ in LOGS])).alias("masked"))


MOMENTS = [("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T03:04:05+02:00", 1704157445), ("2024-01-02", 1704153600), ("soon", None), ("", None)]


@query(f"SELECT event_id, seconds::BIGINT AS seconds, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN NULL ELSE 1.5 END AS number FROM events JOIN (SELECT * FROM {values([(i, m) for i, (_, m) in enumerate(MOMENTS)], 'i, seconds')}) t ON event_id % {len(MOMENTS)} = i")
def parsed_moments(spark, d):
    """Dates and numbers of advisories: what cannot be read is null."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.lit("n/a")).otherwise(F.lit(" 1.5 "))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(tx.moment(picked("event_id", [m for m, _ in MOMENTS]))).alias("seconds"), tx.number(said).alias("number"))
