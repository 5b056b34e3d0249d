"""Queries over the driver tables, one per operator family, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as tx
from quarrylight.functions import versions as vs
from quarrylight.operators import advisories, answers, chunking, graph, health, imports, metrics, relational, remediation, retrieval, sweeps
from quarrylight.sources import advisory_data
from quarrylight.sources.shared import shared_dir
from quarrylight.plans.registry import ORACLES, QUERIES, query, table, values  # noqa: F401
from quarrylight.streaming import ingest

# --- retrieval ---------------------------------------------------------------------------------

TERMS = ["the", "and"]
_BM25 = """
WITH tok AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents),
c AS (SELECT doc_id, lang, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b FROM tok),
s AS (SELECT count(*) AS n, avg(n) AS av, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM c),
r AS (SELECT doc_id, lang,
  CASE WHEN a > 0 THEN ln(1 + (s.n - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * c.n / av)) ELSE 0 END +
  CASE WHEN b > 0 THEN ln(1 + (s.n - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * c.n / av)) ELSE 0 END AS raw FROM c, s)
"""


def _lexical(spark, d, where=None, limit=20):
    hits = retrieval.bm25(table(spark, d, "documents"), TERMS, "doc_id", "text", where)
    hits = hits.select("doc_id", F.col("raw_score").alias("raw"), F.round("raw_score", 6).alias("raw_score"))
    return retrieval.normalised(retrieval.top(hits, "raw_score", "doc_id", limit), "raw", "score")


@query(_BM25 + "SELECT doc_id, round(raw, 6) AS raw_score, round(raw / max(raw) OVER (), 6) AS score, row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id)::INT AS rank FROM r WHERE raw > 0.001 ORDER BY round(raw, 6) DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return _lexical(spark, d).select("doc_id", "raw_score", F.round("score", 6).alias("score"), "rank")


@query(_BM25 + "SELECT doc_id, round(raw, 6) AS raw_score, row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id)::INT AS rank FROM r WHERE raw > 0.001 AND lower(lang) = 'fr' ORDER BY round(raw, 6) DESC, doc_id LIMIT 20")
def bm25_filtered(spark, d):
    """The statistics cover all documents; only French ones are scored."""
    return _lexical(spark, d, F.lower("lang") == "fr").select("doc_id", "raw_score", "rank")


@query("""
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
s AS (SELECT n, CASE WHEN length(w) <= 4 THEN []
  WHEN w LIKE '%ation' THEN [w[:-6], w[:-6] || 'ate'] WHEN w LIKE '%ing' AND length(w) > 5 THEN [w[:-4]] WHEN w LIKE '%ed' THEN [w[:-3], w[:-2]]
  WHEN w LIKE '%es' THEN [w[:-3]] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN [w[:-2]] ELSE [] END AS stems FROM u)
SELECT stem, sum(n)::BIGINT AS n FROM (SELECT unnest(stems) AS stem, n FROM s) GROUP BY stem""")
def stem_tokens(spark, d):
    """How often each stem stands behind the corpus's words; words are counted before they are stemmed."""
    counts = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.explode(tx.stems(F.col("w"))).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


_PROBE = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COS = f"""
WITH p AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT vec_id, round((list_cosine_similarity(e, q) + 1) / 2, 6) AS similarity FROM v, p)
"""


def _probe(spark, d):
    """The vector that is searched for; empty if it is not there, which nothing is like."""
    row = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return row[0] if row else []


@query(_COS + "SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id)::INT AS rank FROM s WHERE similarity > 0.1 ORDER BY similarity DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    hits = retrieval.similar(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding")
    return retrieval.top(hits.withColumn("similarity", F.round("similarity", 6)), "similarity", "vec_id", 20)


@query(_BM25 + "," + _COS.strip()[4:].replace("s AS (SELECT vec_id, round", "cs AS (SELECT vec_id, round") + """,
l AS (SELECT doc_id, row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM r WHERE raw > 0.001 QUALIFY rank <= 40),
m AS (SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM cs WHERE similarity > 0.1 QUALIFY rank <= 40)
SELECT coalesce(doc_id, vec_id) AS doc_id, l.rank::INT AS a_rank, m.rank::INT AS b_rank, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + m.rank), 0), 9) AS rrf
FROM l FULL OUTER JOIN m ON doc_id = vec_id""")
def hybrid_rrf(spark, d):
    lexical = _lexical(spark, d, limit=40).select("doc_id", "rank")
    hits = retrieval.similar(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))
    near = retrieval.top(hits, "similarity", "vec_id", 40).select(F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.fused(lexical, near, "doc_id").withColumn("rrf", F.round("rrf", 9))


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT doc_id, n, ('0x' || substr(sha256(w), 1, 8))::BIGINT AS h FROM u)
SELECT doc_id, (h % 64)::INT AS bucket, sum(CASE WHEN (h >> 1) & 1 = 0 THEN n ELSE -n END)::BIGINT AS value FROM h GROUP BY ALL""")
def feature_hash_buckets(spark, d):
    """Word counts hashed to 64 signed buckets; a document's words are counted before they are hashed."""
    counts = table(spark, d, "documents").select("doc_id", F.explode(tx.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    signed = F.sum(tx.sign_of(F.col("h")).cast("long") * F.col("n"))
    return counts.withColumn("h", tx.hash_head(F.col("w"))).groupBy("doc_id", tx.bucket_of(F.col("h"), 64).alias("bucket")).agg(signed.alias("value"))


_CITE = "source || '/' || doc_id"


@query(_BM25 + f""", h AS (SELECT doc_id, round(raw, 6) AS raw FROM r WHERE raw > 0.001 ORDER BY round(raw, 6) DESC, doc_id LIMIT 8),
k AS (SELECT {_CITE} AS path, {_CITE} || ':L1-L' || len(string_split(text, chr(10))) AS c, left(coalesce(list_filter(string_split(text, chr(10))[1:8], lambda x: trim(x) <> '')[1], 'N/A'), 90) AS p, row_number() OVER (ORDER BY raw DESC, doc_id) AS n FROM h JOIN documents USING (doc_id))
SELECT 'the and' AS question, CASE WHEN count(*) = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'HIGH' END AS confidence, string_agg(c, ' ' ORDER BY n) AS citations,
md5(count(*) || ' places in ' || count(DISTINCT path) FILTER (n <= 5) || ' files on: the and' || chr(10) || string_agg(n || '. [' || c || '] ' || p, chr(10) ORDER BY n) FILTER (n <= 5)) AS answer FROM k""")
def grounded_answer(spark, d):
    docs = table(spark, d, "documents")
    found = answers.evidence(_lexical(spark, d), docs, "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), "text", F.lit(1), F.size(F.split("text", "\n")))
    return answers.answered(found, "the and").select("question", "confidence", F.array_join("citations", " ").alias("citations"), F.md5("answer").alias("answer"))


# --- chunks and texts --------------------------------------------------------------------------


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
w AS (SELECT doc_id, s, len(s) AS n, unnest(range(0, 1 + ceil(greatest(len(s) - 50, 0) / 45.0)::BIGINT)) AS i FROM l),
c AS (SELECT doc_id, i, 1 + 45 * i AS a, least(n, 50 + 45 * i) AS b, array_to_string(s[1 + 45 * i : 50 + 45 * i], chr(10)) AS x FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, a::INT AS start_line, b::INT AS end_line, sha256(x) AS content_hash
FROM c WHERE regexp_matches(x, '\S')""")
def chunk_line_window(spark, d):
    cut = chunking.line_windows(table(spark, d, "documents"), "doc_id", "text", most=None)
    return cut.select("doc_id", "chunk_index", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query("""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents), h AS (SELECT doc_id, n, i, i % 5 + 1 AS level FROM l WHERE i % 3 = 1 AND i % 5 < 4)
SELECT doc_id, 'h' || i || ' x' AS title, level::INT AS level, (i + 1)::INT AS start_line, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n)::INT AS end_line FROM h""")
def chunk_headings(spark, d):
    """All documents, every third of whose lines is made a heading of one to five signs; five are none."""
    made = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.repeat(F.lit("#"), i % 5 + 1), F.lit(" h"), i.cast("string"), F.lit(" x"))).otherwise(x))
    return chunking.headings(table(spark, d, "documents").select("doc_id", F.array_join(made, "\n").alias("text")), "doc_id", "text")


@query(r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
f AS (SELECT doc_id, s, 1 AS line, strlen(s[1]) + 1 AS size, 1 AS part FROM l
  UNION ALL
  SELECT doc_id, s, line + 1, CASE WHEN size + strlen(s[line + 1]) + 1 > 8192 THEN strlen(s[line + 1]) + 1 ELSE size + strlen(s[line + 1]) + 1 END,
         CASE WHEN size + strlen(s[line + 1]) + 1 > 8192 THEN part + 1 ELSE part END FROM f WHERE line < len(s))
SELECT doc_id, part, min(line) AS start_line, max(line) AS end_line FROM f GROUP BY doc_id, part""")
def chunk_byte_split(spark, d):
    return chunking.byte_parts(table(spark, d, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, source || '/' || doc_id || ':L1-L' || len(string_split(text, chr(10))) AS citation,
md5(array_to_string(string_split(text, chr(10))[1:8], chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 8 THEN chr(10) || '... [' || (len(string_split(text, chr(10))) - 8) || ' more lines]' ELSE '' END) AS excerpt FROM documents""")
def excerpt_citation(spark, d):
    docs = table(spark, d, "documents")
    cite = F.concat("source", F.lit("/"), "doc_id", F.lit(":L1-L"), F.size(F.split("text", "\n")))
    return docs.select("doc_id", cite.alias("citation"), F.md5(tx.excerpt(F.col("text"))).alias("excerpt"))


def _redact_sql(x: str) -> str:
    for p in tx.INJECTIONS:
        x = f"regexp_replace({x}, '{p}', '{tx.REDACTED}', 'gi')"
    return x


@query(f"SELECT conv_id, turn, md5({_redact_sql('text')}) AS redacted, {_redact_sql('text')} <> text AS suspicious FROM conversations")
def prompt_redaction(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.md5(tx.redacted(F.col("text"))).alias("redacted"), tx.suspicious(F.col("text")).alias("suspicious"))


# --- inventory ---------------------------------------------------------------------------------

_LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END"


@query(f"SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, sum({_LINES})::BIGINT AS lines, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage FROM documents GROUP BY lang")
def language_distribution(spark, d):
    files = table(spark, d, "documents").select("lang", F.octet_length("text").alias("size"), tx.line_count(F.col("text")).alias("n"))
    return metrics.ordered(metrics.distribution(files, "lang", "size", "n"), "lang")


@query("""WITH p AS (SELECT ltrim(regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1), '/') AS path, strlen(html) AS n FROM pages)
SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '/ (root)' END AS directory, count(*) AS files, sum(n)::BIGINT AS bytes FROM p GROUP BY 1""")
def top_dirs(spark, d):
    path = F.ltrim(F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1), F.lit("/"))
    files = table(spark, d, "pages").select(tx.top_directory(path).alias("directory"), F.octet_length("html").alias("n"))
    return files.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"))


@query("SELECT doc_id, strlen(text)::BIGINT AS size FROM documents ORDER BY 2 DESC, 1 LIMIT 10")
def largest_files(spark, d):
    return metrics.largest(table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size")), "doc_id", "size")


SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
_SEV = "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' END"


def _severity():
    e = F.col("event_type")
    return F.when(e == "error", "CRITICAL").when(e == "purchase", "HIGH").when(e == "signup", "MEDIUM").when(e == "click", "LOW")


@query(f"SELECT value, count(s)::BIGINT AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) v(value) LEFT JOIN (SELECT {_SEV} AS s FROM events) ON s = value GROUP BY value")
def severity_histogram(spark, d):
    return relational.histogram(table(spark, d, "events"), _severity(), SEVERITIES)


# --- filters, latest rows, duplicates ------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND upper(o_orderstatus) = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def paged_filter(spark, d):
    kept = table(spark, d, "orders").filter(relational.matches("o_orderpriority", "Urgent") & (F.upper("o_orderstatus") == "O"))
    return relational.page(kept, [F.desc("o_totalprice"), "o_orderkey"], 2, 50).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark, d):
    """The latest finished order of a customer, or the latest of any kind."""
    order = F.struct(F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey")
    return relational.latest(table(spark, d, "orders"), ["o_custkey"], order, ["o_orderkey", "o_totalprice"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line::INT AS line, row_number() OVER w::INT AS occurrence, min(line) OVER (PARTITION BY doc_id, x)::INT AS first_line FROM l WHERE trim(x) <> '' WINDOW w AS (PARTITION BY doc_id, x ORDER BY line) QUALIFY occurrence > 1""")
def repeated_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    lines = lines.filter(F.trim("x") != "").select("doc_id", "x", (F.col("i") + 1).alias("line"))
    return relational.repeats(lines, ["doc_id", "x"], "line").select("doc_id", "line", "occurrence", "first_line")


@query("SELECT fp AS fingerprint, min(event_id) AS event_id, count(*) AS n FROM (SELECT event_id, sha256(user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d')) AS fp FROM events) GROUP BY fp")
def fingerprint_dedup(spark, d):
    fp = tx.fingerprint(F.col("user_id"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").groupBy(fp.alias("fingerprint")).agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


@query("""WITH dec AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_size <= 40), res AS (SELECT l_partkey AS k, CASE WHEN min(l_linenumber) > 1 THEN '' ELSE max(l_shipdate)::DATE::VARCHAR END AS v FROM lineitem GROUP BY l_partkey)
SELECT dec.k, dec.v AS declared, nullif(res.v, '') AS resolved, true AS is_direct FROM dec LEFT JOIN res USING (k)
UNION ALL SELECT res.k, NULL, res.v, false FROM res WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.k = res.k AND coalesce(res.v, '') <> '')""")
def reconcile_left_anti_union(spark, d):
    declared = table(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("version"))
    when = F.when(F.min("l_linenumber") > 1, "").otherwise(F.max("l_shipdate").cast("date").cast("string"))
    resolved = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(when.alias("version"))
    return relational.reconcile(declared, resolved, "k")


@query("""WITH s AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS a, (floor(epoch(ts)) + floor(value * 60))::BIGINT AS b FROM events)
SELECT x.user_id, x.event_id AS a_id, y.event_id AS b_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a <= y.b AND y.a <= x.b""")
def interval_conflicts(spark, d):
    at = F.unix_timestamp("ts")
    spans = table(spark, d, "events").select("user_id", "event_id", at.alias("a"), (at + F.floor(F.col("value") * 60)).cast("long").alias("b"))
    return relational.overlaps(spans, "user_id", "event_id", "a", "b", 6 * 3600)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def ci_idempotent_ingest(spark, d):
    """The table as a stream, delivered twice to one sink: every key once."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    for delivery in ("first", "again"):
        # The brackets make a pattern of the name, so a single file can be a stream too.
        stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").select(*rows.columns)
        ingest.start(stream, f"{base}/sink", f"{base}/{delivery}", ["user_id", "event_type"], "event_id").awaitTermination()
    return spark.read.parquet(f"{base}/sink").select(*rows.columns)


# --- versions ----------------------------------------------------------------------------------

#: A version for each order, its parts as a list that compares as versions do, and whether it is a prerelease.
_SEMVER = """(SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 3 AS b, o_orderkey % 5 AS c, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey % 12 END AS rc FROM orders)"""
_VERSIONED = f"""WITH v AS (SELECT *, a || '.' || b || '.' || c || CASE WHEN rc IS NULL THEN '' ELSE '-rc.' || rc END AS version, [a, b, c, CASE WHEN rc IS NULL THEN 1 ELSE 0 END, coalesce(rc, 0)]::BIGINT[] AS k FROM {_SEMVER})"""


def _versions(spark, d) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    plain = F.concat_ws(".", (o % 4).cast("string"), (c % 3).cast("string"), (o % 5).cast("string"))
    version = F.when(o % 6 == 0, F.concat(plain, F.lit("-rc."), (c % 12).cast("string"))).otherwise(plain)
    return table(spark, d, "orders").select("o_orderkey", version.alias("version"))


@query(_VERSIONED + " SELECT o_orderkey, version, dense_rank() OVER (ORDER BY k)::INT AS rank FROM v")
def semver_match(spark, d):
    """The rank of every row's version among all versions; different versions alone are sorted, as bytes, over all tasks."""
    rows = _versions(spark, d)
    keys = rows.select("version").distinct().select(F.col("version").alias("v"), vs.semver_bytes(vs.semver_key(F.col("version"))).alias("k"))
    ranks = sweeps.ranked(keys, [], ["k"]).select("v", (F.col("rank") + 1).cast("int").alias("rank"))
    return rows.join(ranks, F.col("version") == F.col("v")).select("o_orderkey", "version", "rank")


_EVENTS = [("introduced", "0"), ("fixed", "1.2.0"), ("introduced", "2.0.0"), ("last_affected", "2.1.3")]


@query(_VERSIONED + " SELECT o_orderkey, k < [1, 2, 0, 1, 0] OR (k >= [2, 0, 0, 1, 0] AND k <= [2, 1, 3, 1, 0]) AS matched, CASE WHEN k < [1, 2, 0, 1, 0] THEN '1.2.0' ELSE '3.0.0' END AS fix FROM v")
def osv_match(spark, d):
    events = F.array(*[F.struct(F.lit(k).alias("kind"), vs.semver_key(F.lit("0.0.0-0" if v == "0" else v)).alias("key")) for k, v in _EVENTS])
    fixes = F.array(*[F.struct(vs.semver_key(F.lit(v)).alias("key"), F.lit(v).alias("text")) for v in ("1.2.0", "3.0.0")])
    rows = _versions(spark, d).withColumn("key", vs.semver_key(F.col("version")))
    return rows.select("o_orderkey", vs.in_events(F.col("key"), events).alias("matched"), vs.remediation(F.col("key"), fixes).alias("fix"))


#: A range, and the same as a condition on ``k``; prereleases count only where the range names one of the same version.
_NPM = [
    ("^1.2.0", "k[4] = 1 AND k >= [1, 2, 0, 1, 0] AND k < [2, 0, 0, 0, 0]"), ("^0.2.3", "k[4] = 1 AND k >= [0, 2, 3, 1, 0] AND k < [0, 3, 0, 0, 0]"), ("~1.1.2", "k[4] = 1 AND k >= [1, 1, 2, 1, 0] AND k < [1, 2, 0, 0, 0]"), (">= 1.1.0 <3", "k[4] = 1 AND k >= [1, 1, 0, 1, 0] AND k < [3, 0, 0, 0, 0]"),
    ("1.0.3 - 2.1.4", "k >= [1, 0, 3, 1, 0] AND k <= [2, 1, 4, 1, 0]"), ("^1.0.0 || ^3.0.0", "k[4] = 1 AND (k[1] = 1 OR k[1] = 3)"), ("*", "k[4] = 1"), (">=2.1.2-rc.5 <3.0.0", "k >= [2, 1, 2, 0, 5] AND k < [3, 0, 0, 1, 0] AND (k[4] = 1 OR k[1:3] = [2, 1, 2])"), ("nonsense", "false"),
]


@query(_VERSIONED + " SELECT o_orderkey, CASE (o_orderkey // 7) % " + str(len(_NPM)) + " " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(_NPM)) + " END AS matched FROM v")
def npm_ranges(spark, d):
    picked = F.element_at(F.array(*[F.lit(r) for r, _ in _NPM]), (F.floor(F.col("o_orderkey") / 7) % len(_NPM) + 1).cast("int"))
    rows = _versions(spark, d).withColumn("expression", picked)
    return advisories.satisfied(rows, "version", "expression").select("o_orderkey", "matched")


#: A version's parts and what stands behind them (-1: rc, 0: nothing, 1: post), as a list that compares as versions do; and specifiers on it.
_PEP = """WITH v AS (SELECT o_orderkey, [o_orderkey % 4, o_custkey % 3, o_orderkey % 5]::BIGINT[] AS r, CASE o_orderkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS t FROM orders), w AS (SELECT *, list_append(r, t::BIGINT) AS k FROM v)"""
_PEP440 = [
    (">=1.1, <3.0", "k >= [1, 1, 0, 0] AND k < [3, 0, 0, -1]"), ("==1.2.*", "k[1:2] = [1, 2]"), ("!=1.2.*", "k[1:2] <> [1, 2]"), ("~=1.1.2", "k >= [1, 1, 2, 0] AND k[1:2] = [1, 1]"), ("~=1.1", "k >= [1, 1, 0, 0] AND k[1] = 1"),
    (">2.0.3", "k > [2, 0, 3, 1]"), ("==2.1", "k = [2, 1, 0, 0]"), ("<=2.1.0", "k <= [2, 1, 0, 0]"), ("!=2.1.0, >1", "k <> [2, 1, 0, 0] AND k > [1, 0, 0, 1]"),
]


@query(_PEP + " SELECT o_orderkey, CASE (o_orderkey // 7) % " + str(len(_PEP440)) + " " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(_PEP440)) + " END AS matched FROM w")
def pep440_specifiers(spark, d):
    o = F.col("o_orderkey")
    tail = F.when(o % 6 == 0, "rc1").when(o % 6 == 1, ".post1").otherwise("")
    version = F.concat(F.concat_ws(".", (o % 4).cast("string"), (F.col("o_custkey") % 3).cast("string"), (o % 5).cast("string")), tail)
    picked = F.element_at(F.array(*[F.lit(r) for r, _ in _PEP440]), (F.floor(o / 7) % len(_PEP440) + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", version.alias("version"), picked.alias("expression"))
    return advisories.satisfied(rows, "version", "expression", python=True).select("o_orderkey", "matched")


_ADVISORIES = [
    ("A1", "npm", "left", [(">=1.0.0 <1.2.0", None)], ["1.2.0"]), ("A2", "npm", "left", [(None, [("0", None, None, None), (None, "1.1.0", None, None), ("2.0.0", None, None, None), (None, None, "2.1.0", None)])], None),
    ("A3", "PyPI", "my-lib", [(">=1.0,<1.2", None), (None, [("2.0", None, None, None), (None, "2.2", None, None)])], ["1.2", "2.2"]), ("A4", "cargo", "left", [("*", None)], None),
]


@query("""WITH v AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'cargo' ELSE 'npm' END AS ecosystem, CASE o_orderkey % 4 WHEN 1 THEN 'my-lib' WHEN 3 THEN 'none' ELSE 'left' END AS package,
 CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 4 || '.' || o_custkey % 3 || '.' || o_custkey % 5 END AS version, CASE WHEN o_custkey % 11 <> 0 THEN [o_custkey % 4, o_custkey % 3, o_custkey % 5]::BIGINT[] END AS k FROM orders),
m AS (SELECT v.*, 'A1' AS advisory_id, k >= [1, 0, 0] AND k < [1, 2, 0] AS hit, '1.2.0' AS fix FROM v WHERE ecosystem = 'npm' AND package = 'left' UNION ALL SELECT v.*, 'A2', k < [1, 1, 0] OR (k >= [2, 0, 0] AND k <= [2, 1, 0]), '1.1.0' FROM v WHERE ecosystem = 'npm' AND package = 'left'
 UNION ALL SELECT v.*, 'A3', (k >= [1, 0, 0] AND k < [1, 2, 0]) OR (k >= [2, 0, 0] AND k < [2, 2, 0]), CASE WHEN k < [1, 2, 0] THEN '1.2' ELSE '2.2' END FROM v WHERE ecosystem = 'PyPI' UNION ALL SELECT v.*, 'A4', NULL, NULL FROM v WHERE ecosystem = 'cargo')
SELECT ecosystem, package, version, advisory_id, coalesce(hit, false) AS matched, hit IS NULL AS indeterminate, CASE WHEN hit THEN fix END AS remediation FROM m""")
def advisory_match(spark, d):
    """Every different version of every package against the advisories of its name."""
    known = spark.createDataFrame(_ADVISORIES, f"advisory_id string, ecosystem string, package string, ranges {advisories.RANGES}, fixed_versions array<string>")
    o, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    version = F.when(c % 11 != 0, F.concat_ws(".", (c % 4).cast("string"), (c % 3).cast("string"), (c % 5).cast("string")))
    used = table(spark, d, "orders").select(F.when(o == 1, "PyPI").when(o == 2, "cargo").otherwise("npm").alias("ecosystem"), F.when(o == 1, "my-lib").when(o == 3, "none").otherwise("left").alias("package"), version.alias("version"))
    return advisories.affected(used, known)


@query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE 'A' || p_partkey // 3 END AS id, CASE p_partkey % 4 WHEN 0 THEN ' PyPI' ELSE 'npm' END AS eco, CASE p_partkey % 4 WHEN 0 THEN 'My__Lib' ELSE 'Left ' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'odd' ELSE 'Low' END AS sev FROM part),
c AS (SELECT *, lower(trim(eco)) AS e, CASE WHEN eco = ' PyPI' THEN 'my-lib' ELSE 'left' END AS p FROM r)
SELECT k AS turn, id AS advisory_id, e AS ecosystem, p AS package, CASE sev WHEN 'critical' THEN 'CRITICAL' WHEN 'odd' THEN 'UNKNOWN' ELSE 'LOW' END AS severity, CASE WHEN k % 3 = 0 THEN 7.5::DOUBLE END AS cvss_score, CASE WHEN id IS NULL THEN 'missing' WHEN k > min(k) OVER (PARTITION BY id, e, p) THEN 'repeated' END AS problem FROM c""")
def advisory_import(spark, d):
    """Advisories as they come: which are taken, and what their fields become."""
    k = F.col("p_partkey")
    raw = table(spark, d, "part").select(
        k.alias("turn"), F.when(k % 9 != 4, F.concat(F.lit("A"), F.floor(k / 3).cast("string"))).alias("advisory_id"), F.when(k % 4 == 0, " PyPI").otherwise("npm").alias("ecosystem"), F.when(k % 4 == 0, "My__Lib").otherwise("Left ").alias("package_name"), F.lit("s").alias("summary"),
        F.when(k % 5 == 0, "critical").when(k % 5 == 1, "odd").otherwise("Low").alias("severity"), F.when(k % 3 == 0, "7.5").otherwise("high").alias("cvss_score"), F.lit(None).cast("array<string>").alias("cve_ids"), F.array().cast(f"array<{advisory_data.RANGE}>").alias("affected_ranges_json"),
        F.lit(None).cast("array<string>").alias("fixed_versions_json"), F.lit("2024-01-01T00:00:00Z").alias("published_at"), F.lit("").alias("modified_at"),
    )
    return advisory_data.judged(raw).select("turn", "advisory_id", "ecosystem", "package", "severity", "cvss_score", "problem")


@query("""WITH f AS (SELECT p_partkey AS k, 'app/d' || p_partkey % 10 || '/m' || p_partkey || '.py' AS path FROM part), n AS (SELECT max(k) AS last FROM f)
SELECT path AS source, k AS line, CASE k % 5 WHEN 0 THEN 'app.d' || (k + 1) % 10 || '.m' || (k + 1) WHEN 1 THEN 'm' || (k + 10) WHEN 2 THEN 'numpy.linalg' WHEN 3 THEN 'app.none' ELSE 'X' END AS name,
CASE k % 5 WHEN 0 THEN CASE WHEN k + 1 <= last THEN 'app/d' || (k + 1) % 10 || '/m' || (k + 1) || '.py' ELSE 'app/__init__.py' END WHEN 1 THEN 'app/d' || k % 10 || '/m' || (k + 10) || CASE WHEN k + 10 <= last THEN '.py' ELSE '' END WHEN 2 THEN 'numpy' WHEN 3 THEN 'app/__init__.py' ELSE 'app/d' || k % 10 || '/m' || k || '.py' END AS target,
CASE WHEN k % 5 = 2 THEN 'external' WHEN k % 5 = 1 AND k + 10 > last THEN 'unresolved' ELSE 'internal' END AS kind FROM f, n""")
def import_resolution(spark, d):
    """Imports of every file: of a module by its whole name, of a neighbour, of a package, of what is not there, of a name in a module."""
    k = F.col("p_partkey")
    path = lambda n: F.concat(F.lit("app/d"), (n % 10).cast("string"), F.lit("/m"), n.cast("string"), F.lit(".py"))
    dotted = lambda n: F.concat(F.lit("app.d"), (n % 10).cast("string"), F.lit(".m"), n.cast("string"))
    kind = k % 5
    name = F.when(kind == 0, dotted(k + 1)).when(kind == 1, F.concat(F.lit("m"), (k + 10).cast("string"))).when(kind == 2, F.lit("numpy.linalg")).when(kind == 3, F.lit("app.none")).otherwise(F.lit("X"))
    found = table(spark, d, "part").select(path(k).alias("source"), F.lit("Python").alias("language"), F.when(kind == 4, dotted(k)).alias("module"), name.alias("name"), kind.isin(1, 4).alias("is_from"), F.when(kind == 1, 1).otherwise(0).alias("level"), k.cast("int").alias("line"))
    files = table(spark, d, "part").select(path(k).alias("path")).unionByName(spark.createDataFrame([("app/__init__.py",)], "path string"))
    return imports.resolved(found, files).select("source", F.col("line").cast("long").alias("line"), "name", "target", "kind")


# --- graphs, governance ------------------------------------------------------------------------

_EDGES = """
WITH e AS (SELECT s_nationkey AS source, c_nationkey AS target, sum(round(l_extendedprice * 100)::BIGINT) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
g AS (SELECT source, target FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY revenue DESC, target) <= 3)
"""


def _edges(spark, d):
    joined = (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    revenue = joined.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("revenue"))
    best = F.row_number().over(W.partitionBy("source").orderBy(F.desc("revenue"), "target"))
    return revenue.withColumn("r", best).filter("r <= 3").select("source", "target")


@query(_EDGES + """, o AS (SELECT source AS m, count(*) AS ce FROM g WHERE source <> target GROUP BY 1), i AS (SELECT target AS m, count(*) AS ca FROM g WHERE source <> target GROUP BY 1)
SELECT n_nationkey AS module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 4) END AS instability
FROM nation LEFT JOIN o ON n_nationkey = o.m LEFT JOIN i ON n_nationkey = i.m""")
def coupling_metrics(spark, d):
    return graph.coupling(table(spark, d, "nation").select(F.col("n_nationkey").alias("module")), _edges(spark, d))


@query(_EDGES.replace("WITH e", "WITH RECURSIVE e") + """, t AS (SELECT source AS a, target AS b FROM g UNION SELECT t.a, g.target FROM t JOIN g ON t.b = g.source)
SELECT x.a AS node, min(x.b) AS component FROM t x JOIN t y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def scc_cycles(spark, d):
    return graph.strong_components(_edges(spark, d))


LAYERS = [("units", ["*_?"]), ("teens", ["*_1*", "NATION_20"]), ("rest", ["*"])]


@query("""SELECT n_nationkey, n_name, CASE WHEN regexp_full_match(n_name, '.*_.') THEN 'units' WHEN contains(n_name, '_1') OR n_name = 'NATION_20' THEN 'teens' ELSE 'rest' END AS layer FROM nation""")
def layer_match(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", graph.layer_of(F.col("n_name"), LAYERS).alias("layer"))


@query(_EDGES + """, r AS (SELECT source, target, a.n_regionkey::VARCHAR AS fl, b.n_regionkey::VARCHAR AS tl FROM g JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey)
SELECT 'no-1-3' AS rule_id, source, target, fl AS from_layer, tl AS to_layer FROM r WHERE fl = '1' AND tl = '3' UNION ALL SELECT 'only-0-1', source, target, fl, tl FROM r WHERE fl = '0' AND tl NOT IN ('0', '1')""")
def layer_violations(spark, d):
    layers = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("layer"))
    edges = _edges(spark, d).join(layers.select(F.col("n_nationkey").alias("source"), F.col("layer").alias("from_layer")), "source").join(layers.select(F.col("n_nationkey").alias("target"), F.col("layer").alias("to_layer")), "target")
    rules = spark.createDataFrame([("no-1-3", "1", "3", None), ("only-0-1", "0", None, ["0", "1"])], "rule_id string, layer string, forbidden string, allowed array<string>")
    return graph.rule_violations(edges, rules)


@query(_EDGES + """SELECT source, target FROM g JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey WHERE regexp_full_match(a.n_name, '.*_1.') AND contains(b.n_name, '_2')""")
def forbidden_patterns(spark, d):
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    edges = _edges(spark, d).join(names.select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("a")), "source").join(names.select(F.col("n_nationkey").alias("target"), F.col("n_name").alias("b")), "target")
    return edges.filter(graph.glob(F.col("a"), "*_1?") & graph.glob(F.col("b"), "*_2*")).select("source", "target")


# --- health, audit -----------------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1),
q AS (SELECT user_id, greatest(0, least(100, 100.0 - 4 * (e // 4) - 2 * (k // 4) - 3 * (s // 4)))::DOUBLE AS m,
 CASE WHEN e % 5 <> 0 THEN greatest(0, 100.0 - 25 * (e // 10) - 6 * (p // 5))::DOUBLE END AS sec,
 greatest(0, 100.0 - least(40, 10 * (e // 8)) - least(50, 15 * (s // 8)) - least(20, 2 * (v // 8)))::DOUBLE AS arch,
 least(v, n - e) * 100.0::DOUBLE / n AS cov FROM c)
SELECT user_id, round((m * 0.25 + coalesce(sec * 0.25, 0) + arch * 0.2 + cov * 0.1) / (0.25 + CASE WHEN sec IS NULL THEN 0 ELSE 0.25 END + 0.2 + 0.1), 6) AS score FROM q""")
def health_score(spark, d):
    """Pillars from each user's events; the security pillar is missing for some, the dependency pillar for all."""
    e = F.col("event_type")
    c = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(e == t).alias(t) for t in ("error", "click", "signup", "purchase", "view")])
    part = lambda name, by: F.floor(F.col(name) / by)
    pillars = {
        "maintainability": health.maintainability(part("error", 4), part("click", 4), part("signup", 4)),
        "security": F.when(F.col("error") % 5 != 0, F.greatest(F.lit(0.0), 100.0 - part("error", 10) * 25.0 - part("purchase", 5) * 6.0)),
        "architecture": health.architecture(part("error", 8), part("signup", 8), part("view", 8)),
        "coverage": health.coverage(F.least("view", F.col("n") - F.col("error")), F.col("n")),
    }
    return c.select("user_id", F.round(health.overall(pillars), 6).alias("score"))


_STATE = "CASE WHEN event_type = 'error' AND value > 450 THEN 'FAILED' WHEN event_type = 'error' AND value > 300 THEN 'WARNING' WHEN event_type = 'error' THEN 'SKIPPED' WHEN value < 5 THEN 'ERROR' ELSE 'PASSED' END"


@query(f"""WITH s AS (SELECT user_id, {_STATE} AS st FROM events), c AS (SELECT user_id, count(*) FILTER (st = 'PASSED') AS passed, count(*) FILTER (st = 'FAILED') AS failed, count(*) FILTER (st = 'WARNING') AS warning, count(*) FILTER (st = 'SKIPPED') AS skipped, 0::BIGINT AS unsupported, count(*) FILTER (st = 'ERROR') AS error FROM s GROUP BY 1)
SELECT *, CASE WHEN failed > 0 THEN 'FAILED' WHEN warning > 0 THEN 'WARNING' WHEN error > 0 THEN 'ERROR' ELSE 'PASSED' END AS overall FROM c""")
def audit_rollup(spark, d):
    return table(spark, d, "events").withColumn("st", F.expr(_STATE)).groupBy("user_id").agg(*health.rollup(F.col("st")))


# --- patches -----------------------------------------------------------------------------------

_SECRET = b"a shared secret"
_PADS = [bytes(k ^ x for k in _SECRET.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"SELECT event_id, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(props)))) AS signature, event_id % 3 = 0 AS verified FROM events")
def signed_payloads(spark, d):
    """Every third event carries its own signature, the others that of another text or none."""
    sign = lambda c: remediation.hmac_sha256(c, _SECRET)
    sent = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sha256="), sign(F.col("props")))).when(F.col("event_id") % 3 == 1, sign(F.lit("other")))
    return table(spark, d, "events").select("event_id", sign(F.col("props")).alias("signature"), remediation.verified(F.col("props"), sent, _SECRET).alias("verified"))


_STEP = "CASE event_type WHEN 'signup' THEN 'PROPOSED' WHEN 'view' THEN 'VALIDATED' WHEN 'click' THEN 'APPROVED' WHEN 'purchase' THEN 'APPLIED' ELSE 'STALE' END"
_ALLOWED = ", ".join(f"'{before or ''}>{after}'" for before, some in remediation.FOLLOWS.items() for after in some)


@query(f"""WITH s AS (SELECT user_id, ts, event_id, {_STEP} AS state FROM events), l AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') || '>' || state AS step FROM s)
SELECT user_id, arg_max(state, (ts, event_id)) AS state, count(*) AS steps, count(*) FILTER (step NOT IN ({_ALLOWED})) AS invalid FROM l GROUP BY user_id""")
def proposal_standing(spark, d):
    return remediation.standing(table(spark, d, "events").withColumn("state", F.expr(_STEP)), "user_id", "state", ["ts", "event_id"])


_PATHS = [("src/.env", True), ("src/.env.local", True), (".git/config", True), ("keys/server.PEM", True), ("../a.py", True), ("C:/a.py", True), ("src\\secrets.yml", True), ("/src/main.py", False), ("src/tokenizer.py", False), (" ", True)]


@query(f"SELECT p_partkey, path, protected FROM part JOIN (SELECT * FROM {values([(i, *x) for i, x in enumerate(_PATHS)], 'i, path, protected')}) t ON p_partkey % {len(_PATHS)} = i")
def protected_paths(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(p) for p, _ in _PATHS]), (F.col("p_partkey") % len(_PATHS) + 1).cast("int")).alias("path"))
    return rows.withColumn("protected", remediation.protected(F.col("path")))


@query("""WITH b AS (SELECT p_partkey AS k, p_size AS s, 'f' || p_partkey // 4 || '.py' AS path, CASE p_partkey % 5 WHEN 4 THEN 'REJECTED' WHEN 0 THEN 'APPROVED' ELSE 'VALIDATED' END AS state FROM part), r AS (SELECT *, 2 + k % 3 AS a, 2 + k % 3 + k % 2 AS z FROM b WHERE state <> 'REJECTED'),
c AS (SELECT x.k, min(y.k) AS conflict FROM r x JOIN r y ON x.path = y.path AND x.k <> y.k AND x.a <= y.z AND y.a <= x.z GROUP BY 1)
SELECT k AS proposal_id, path AS file_path, conflict, '# ' || path || ' (R' || k % 2 || ')' || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,' || least(z + 3, 7) || ' +1,' || (least(z + 3, 7) - (z - a)) || ' @@' || chr(10)
 || array_to_string(list_transform(range(1, a), lambda i: ' l' || i || chr(10)), '') || array_to_string(list_transform(range(a, z + 1), lambda i: '-l' || i || chr(10)), '') || '+new ' || s || chr(10) || array_to_string(list_transform(range(z + 1, least(z + 3, 7) + 1), lambda i: ' l' || i || chr(10)), '') AS patch FROM r LEFT JOIN c USING (k)""")
def patch_bundle(spark, d):
    """A proposal for each row, four to a file; those that are ready, with their patches and conflicts."""
    return remediation.bundle(_proposals(spark, d))


@query("""WITH b AS (SELECT p_partkey AS k, 'f' || p_partkey // 4 || '.py' AS path FROM part WHERE p_partkey % 5 <> 4), r AS (SELECT *, 2 + k % 3 AS a, 2 + k % 3 + k % 2 AS z FROM b)
SELECT len(list(DISTINCT path))::INT AS files, list_sort(list(DISTINCT 'R' || k % 2)) AS rules, (SELECT count(DISTINCT x.k) FROM r x JOIN r y ON x.path = y.path AND x.k <> y.k AND x.a <= y.z AND y.a <= x.z) AS conflicts FROM r""".replace("list_sort(list(DISTINCT 'R' || k % 2))", "array_to_string(list_sort(list(DISTINCT 'R' || k % 2)), ' ')"))
def bundle_summary(spark, d):
    rows = _proposals(spark, d)
    told = remediation.bundle_summary(remediation.bundle(rows), rows)
    return told.select(F.size("files").alias("files"), F.array_join("rules", " ").alias("rules"), "conflicts")


def _proposals(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    start = (2 + k % 3).cast("int")
    return table(spark, d, "part").select(
        k.alias("proposal_id"), F.concat(F.lit("f"), F.floor(k / 4).cast("string"), F.lit(".py")).alias("file_path"), start.alias("start_line"), (start + k % 2).cast("int").alias("end_line"),
        F.when(k % 5 == 4, "REJECTED").when(k % 5 == 0, "APPROVED").otherwise("VALIDATED").alias("state"), F.concat(F.lit("R"), (k % 2).cast("string")).alias("rule_id"),
        F.lit("l1\nl2\nl3\nl4\nl5\nl6\nl7\n").alias("before"), F.concat(F.lit("new "), F.col("p_size").cast("string")).alias("new"),
    )


from quarrylight.plans import code_catalogue, search_catalogue, state_catalogue, store_catalogue  # noqa: E402, F401
