"""Queries on indexes that are kept, searches by mode, listings, and sets that are swapped."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.functions.text import words
from quarrylight.operators import chunking, increments, kept_index, relational, retrieval
from quarrylight.plans.catalogue import _BM25, _COS, ORACLES, _lexical, _probe, _proposals
from quarrylight.plans.registry import query, table
from quarrylight.sources import advisory_data
from quarrylight.sources.shared import shared_dir


@query(_BM25 + "SELECT doc_id, round(raw, 6) AS raw_score FROM r WHERE raw > 0.001 ORDER BY round(raw, 6) DESC, doc_id LIMIT 20")
def kept_index_topk(spark, d):
    """The best of all documents from an index that was written and is read in part."""
    base = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    kept_index.build(table(spark, d, "documents"), base, "doc_id", words(F.col("text")))
    # Scores are rounded before ties go by key, so some more are asked for.
    hits = kept_index.top(spark, base, ["the", "and"], 40).hits.select(F.col("key").alias("doc_id"), F.round("raw_score", 6).alias("raw_score"))
    return hits.orderBy(F.desc("raw_score"), "doc_id").limit(20)


_STATES = """(VALUES ('none', false, false), ('words', true, false), ('vectors', true, true)) s(state, lexical, semantic)"""


@query(_BM25 + "," + _COS.strip()[4:].replace("s AS (SELECT vec_id, round", "cs AS (SELECT vec_id, round") + f""",
l AS (SELECT doc_id AS k, row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM r WHERE raw > 0.001 QUALIFY rank <= 10),
m AS (SELECT vec_id AS k, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM cs WHERE similarity > 0.1 QUALIFY rank <= 10),
f AS (SELECT coalesce(l.k, m.k) AS k, row_number() OVER (ORDER BY coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + m.rank), 0) DESC, coalesce(l.rank, 21), coalesce(m.rank, 21)) AS rank FROM l FULL OUTER JOIN m ON l.k = m.k),
e AS (SELECT 'lexical' AS list, k, rank FROM l UNION ALL SELECT 'semantic', k, rank FROM m UNION ALL SELECT 'hybrid', k, rank FROM f),
g AS (SELECT list, string_agg(k, ' ' ORDER BY rank) AS keys, count(*) AS results FROM e WHERE rank <= 5 GROUP BY 1),
w AS (SELECT state, mode, lexical, semantic, CASE WHEN NOT lexical THEN NULL WHEN mode = 'hybrid' AND NOT semantic THEN 'lexical' WHEN mode = 'semantic' AND NOT semantic THEN NULL ELSE mode END AS list FROM {_STATES}, (VALUES ('lexical'), ('semantic'), ('hybrid')) q(mode))
SELECT state, mode AS mode_requested, CASE WHEN mode = 'hybrid' AND lexical AND NOT semantic THEN 'lexical_fallback' ELSE mode END AS mode_used, CASE WHEN NOT lexical THEN 'NOT_INDEXED' WHEN semantic THEN 'HYBRID' ELSE 'LEXICAL' END AS status,
coalesce(results, 0) AS results, CASE WHEN NOT lexical THEN 'nothing is indexed' WHEN mode <> 'lexical' AND NOT semantic THEN 'no chunk has a vector' END AS warning, coalesce(keys, '') AS keys FROM w LEFT JOIN g USING (list)""")
def search_modes(spark, d):
    """Three modes on what is not indexed, indexed without vectors, and indexed with them."""
    lexical = _lexical(spark, d, limit=10).select(F.col("doc_id").alias("k"), "rank", "score")
    near = retrieval.similar(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))
    semantic = retrieval.top(near, "similarity", "vec_id", 10).select(F.col("vec_id").alias("k"), "rank", F.col("similarity").alias("score"))
    whole = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "embedding")
    told = None
    for state, chunks in (("none", whole.limit(0)), ("words", whole.withColumn("embedding", F.lit(None).cast("array<float>"))), ("vectors", whole)):
        for mode in ("lexical", "semantic", "hybrid"):
            answer = retrieval.by_mode(mode, chunks, "embedding", lexical, semantic, "k", 5)
            keys = answer.results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"].cast("string")), " ").alias("keys"))
            row = answer.report.join(F.broadcast(keys)).select(F.lit(state).alias("state"), "*")  # one row
            told = row if told is None else told.unionByName(row)
    return told


@query("SELECT p_partkey AS proposal_id, 'f' || p_partkey // 4 || '.py' AS file_path, 'R1' AS rule_id, count(*) OVER () AS total FROM part WHERE p_partkey % 5 IN (1, 2, 3) AND p_partkey % 2 = 1 ORDER BY p_partkey DESC LIMIT 25 OFFSET 25")
def proposal_listing(spark, d):
    """The second page of the validated proposals of one rule, latest first, with how many there are."""
    found = relational.listed(_proposals(spark, d), {"state": "VALIDATED", "rule_id": "R1", "file_path": None}, [F.desc("proposal_id")], 2, 25)
    return found.select("proposal_id", "file_path", "rule_id", "total")


@query("SELECT p_partkey, 2::BIGINT AS number, 'v2' AS version FROM part WHERE p_size >= 25")
def swapped_sets(spark, d):
    """Two sets put in place one after the other, and one that came from an old number and is refused: what readers then see."""
    base = f"{shared_dir(spark)}/advisories-{uuid.uuid4().hex}"
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    advisory_data.swap(parts.filter("p_size < 25"), base, "v1")
    advisory_data.swap(parts.filter("p_size >= 25"), base, "v2", expected=1)
    try:
        advisory_data.swap(parts.limit(0), base, "v3", expected=1)
    except RuntimeError:
        pass
    active = advisory_data.status(spark, base).filter("state = 'active'").select("number", "version")
    return advisory_data.current(spark, base).select("p_partkey").join(F.broadcast(active))  # one row


@query("WITH RECURSIVE x AS (" + ORACLES["chunk_documents"].replace("WITH RECURSIVE l AS", "WITH RECURSIVE l AS", 1) + r"""),
y AS (SELECT x.*, array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)) AS t FROM x JOIN documents USING (doc_id))
SELECT doc_id::VARCHAR AS path, chunk_index, sha256('s2:' || doc_id || ':' || start_line || ':' || end_line || ':' || sha256(t)) AS fingerprint FROM y""")
def incremental_index(spark, d):
    """The index of all documents, brought on from one in which some were missing, others different, and some more there."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    now = docs.select(k.cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    old = docs.filter(k % 11 != 0).select(k.cast("string").alias("path"), F.when(k % 7 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")).alias("content"))
    old = old.unionByName(docs.filter(k % 13 == 0).select(F.concat(F.lit("gone-"), k.cast("string")).alias("path"), F.col("text").alias("content")))
    whole = lambda rows: rows.select("path", F.lit(None).cast("string").alias("language"), F.lit(False).alias("is_binary"), "content")
    chunks = chunking.index_run(whole(old), "s1", 8, None)
    read = lambda paths: whole(now.join(paths.select(F.col("path").alias("__p")), F.col("path") == F.col("__p"), "left_semi"))
    made = increments.updated(old.select("path", F.sha2("content", 256).alias("sha256")), chunks, now.select("path", "sha256"), read, "s2", 8, None)
    return made.chunks.select("path", "chunk_index", "fingerprint")
