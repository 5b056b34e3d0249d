"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import ann, conversation_repair, embedding_dedup, hard_negatives, html_extract, language_id, license_scan, lm_scoring, mixing, packing, sharding, simhash, toxicity
from quarrylight.llm.common import id_remainder, table

#: The public vocabulary that packing uses, as ranks and as the tokenizer's file; a path is a parameter of the operator.
VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
SHARDS, NEAREST, LIMIT, COSINE, RADIUS = 8, 20, 1024, 0.98, 2


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the target corpus is the documents that labels call good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, NEAREST)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 5) == 0
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 4) == 2
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=RADIUS)
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=COSINE)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, limit=LIMIT, special=packing.special_tokens(public_tokenizers.path(TOKENIZER)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, seventh = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 7 == 0
    turned = vectors.withColumn("label", F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(turned, F.col("vec_id") % 100 == 0)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The contract's damage by a row's name, and which rows it takes away; nulls count as one space."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", kind.alias("damage"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows, F.col("damage") == 0


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, absent=gone).audits


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base = F.col("scan.found"), F.col("base")
    rows = table(spark, sf_dir, "documents").select("doc_id", license_scan.scanned("text").alias("scan"))
    rows = rows.withColumn("base", license_scan.base_only(found))
    return rows.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        license_scan.labels_of(base).alias("base_labels"), license_scan.labels_of(found).alias("labels"), license_scan.score_of(found).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_sharding, op3_nearest_neighbours, op4_toxicity, op5_html_extraction, op6_language_id, op7_simhash_dedup, op8_embedding_dedup, op9_source_mixing, op10_packing, op11_hard_negatives, op12_conversation_repair, op13_license_scan)
}

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('9:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS chance
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per
), final AS (
  SELECT *, (SELECT arg_min(level, cap / w) FROM levels WHERE cap / w > level) AS final FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, w * final) END AS target FROM final
), rated AS (
  SELECT doc_id, size, source_size, target, chance, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), taken AS (
  SELECT *, (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM rated
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM taken
"""

OP8_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS found FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.found = l.a
), roots AS (SELECT node, min(found) AS component_id FROM reach GROUP BY node), degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON e.vec_id = r.node LEFT JOIN degrees d ON e.vec_id = d.a
"""

OP11_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 5
"""

ORACLES = {"op8_embedding_dedup": OP8_SQL, "op9_source_mixing": OP9_SQL, "op11_hard_negatives": OP11_SQL}
