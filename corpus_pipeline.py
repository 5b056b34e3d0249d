"""A corpus pipeline of five stages: toxicity, language, near-duplicates, source mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import language_id, mixing, packing, simhash, toxicity
from quarrylight.llm.common import settled, table, unused
from quarrylight.llm.queries import LIMIT, RADIUS, TOKENIZER, VOCABULARY

#: A document at this toxicity or more goes.
TOXIC = 0.5
#: A document whose letters resemble no known language this much goes.
LEAST_COSINE = 0.1
#: Documents of so similar sets of shingles of so many words are near-duplicates.
SIMILAR, SHINGLE = 0.8, 5
#: Rows that go are broadcast while they are no more than this (some 50 MB of numbers); beyond it the documents are shuffled to meet them.
BROADCAST_ROWS = 1 << 20
#: Documents that a task sends to Python at a time. Spark's 10,000 are a task's whole share, and it, its copy in Python and what is made of it stand in memory at once.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """No more than BATCH_ROWS rows to a batch from now on: a stage's last step runs when its result is written, so it is not set back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled rows calls toxic go; without usable labels none does.

    Null and empty texts have the prior's score and stay.
    """
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = unused("toxicity", docs.columns)
    return toxicity.scored(docs, model, name=name).filter(F.col(name) < TOXIC).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with letters in an order of no language that the corpus names, go."""
    small_batches(spark)
    pred, score = unused("lang_pred", docs.columns), unused("lang_score", docs.columns)
    found = language_id.identified(docs, language_id.fit(docs), pred=pred, score=score)
    return found.filter((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= LEAST_COSINE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 0.8 in five-word shingles the row with the smallest doc_id stays.

    A row is known by its doc_id and its text's hash; only those are joined back. Of
    rows that repeat both, one stays. Rows without a doc_id stay.
    """
    small_batches(spark)
    found = settled(simhash.similar_texts(docs, radius=RADIUS, shingle=SHINGLE, least=SIMILAR).filter("doc_id IS NOT NULL"), "similar")
    own = (F.col("doc_id") == F.col("component.doc_id")) & (F.col("print") == F.col("component.print"))
    of, is_print = unused("gone_id", docs.columns), unused("gone_print", docs.columns)
    row = (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(is_print))
    named = [F.col("doc_id").alias(of), F.col("print").alias(is_print)]
    gone = settled(found.filter(~own).select(*named).distinct(), "gone")
    # Rows that occur more than once among the kept are few; only they meet.
    often = settled(found.filter(own).groupBy(*named).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "often")
    if gone.count() + often.count() <= BROADCAST_ROWS:
        gone, often = F.broadcast(gone), F.broadcast(often)
    kept = docs.join(gone, row, "left_anti")
    return kept.join(often, row, "left_anti").unionByName(kept.join(often, row, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, as often as its source's rate takes it: copies are rows. A source without any word goes."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document, with its sequence and place; null and empty texts are the end token alone."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, limit=LIMIT, special=packing.special_tokens(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but the mix can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
