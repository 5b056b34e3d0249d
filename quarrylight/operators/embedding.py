"""Feature-hash vectors: what a text's words leave in signed buckets, at unit length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import bucket_of, hash_head, sign_of

#: Unicode word characters.
WORD = r"(?U)\w+"


def hash_buckets(rows: DataFrame, key: list[str], text: str, dimension: int = 64) -> DataFrame:
    """key, bucket, value: signed counts at unit length, six decimals; a bucket that no word fell into gives no row.

    A row's words are counted before any is hashed.
    """
    words = rows.select(*key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("w")).groupBy(*key, "w").agg(F.count(F.lit(1)).alias("n"))
    hashed = words.withColumn("__h", hash_head(F.col("w")))
    values = hashed.groupBy(*key, bucket_of(F.col("__h"), dimension).alias("bucket")).agg(F.sum(sign_of(F.col("__h")) * F.col("n")).alias("value"))
    norms = values.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__norm"))
    same = [values[k].eqNullSafe(norms[f"__{k}"]) for k in key]
    joined = values.join(norms, same)
    return joined.select(*key, "bucket", F.round(F.when(F.col("__norm") > 1e-9, F.col("value") / F.col("__norm")).otherwise(F.col("value")), 6).alias("value"))


def hash_vectors(rows: DataFrame, key: list[str], text: str, dimension: int = 64) -> DataFrame:
    """key and embedding (array of ``dimension`` doubles) of every row; a text without a word has zeros."""
    found = hash_buckets(rows, key, text, dimension).groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("__at"))
    every = F.sequence(F.lit(0), F.lit(dimension - 1))
    joined = rows.select(*key).join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left")
    return joined.select(*key, F.transform(every, lambda i: F.coalesce(F.try_element_at("__at", i), F.lit(0.0))).alias("embedding"))
