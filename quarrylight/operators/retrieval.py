"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions.text import CAMEL_PART, CODE_WORD, code_tokens
from quarrylight.functions.vectors import shifted_cosine
from quarrylight.sources.shared import settled

K1, B, RRF = 1.5, 0.75, 60
#: Different tokens that a task remembers at a time.
MOST_KNOWN = 1 << 19
_WORD, _CAMEL = re.compile(CODE_WORD), re.compile(CAMEL_PART)
LEAST_SCORE, LEAST_SIMILARITY = 0.001, 0.1


def bm25(docs: DataFrame, query: list[str], key: str, text: str, where: Column | None = None, bonus: Column | None = None, tokens=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, raw_score and ``keep`` of every row that ``query`` scores on.

    Corpus statistics cover all of ``docs``; ``where`` only narrows what is scored.
    Texts are read once: each row's length, term counts, filter and bonus are found in
    place and written as a small table, from which statistics and scores follow; no
    token is shuffled. Plain words are counted by two patterns; ``tokens`` (a column
    builder, such as code_tokens) gives arrays to count in instead.
    """
    counted, terms = counts(docs, query, key, text, where, bonus, tokens, keep)
    return scores(settled(counted, "bm25"), terms, key, keep)


def counts(docs: DataFrame, query: list[str], key: str, text: str, where: Column | None = None, bonus: Column | None = None, tokens=None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Each row's key, ``keep``, length, count of each query term, whether it is scored, and bonus; and the terms."""
    terms = list(dict.fromkeys(query))
    if tokens is None:
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        length = F.regexp_count(low, F.lit(r"[a-z0-9_]+"))
        any_term = "|".join(map(re.escape, terms))
        hits = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9_])(?:{any_term})(?![a-z0-9_])"), F.lit(0)) if terms else F.array().cast("array<string>")
    else:
        found = tokens(F.col(text))
        length, hits = F.size(found), F.filter(found, lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    scored = (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("__scored")
    extra = (F.lit(0.0) if bonus is None else bonus).cast("double").alias("__bonus")
    read = docs.select(key, *keep, length.cast("long").alias("__len"), hits.alias("__hits"), scored, extra)
    times = [_times(q).alias(f"__tf{i}") for i, q in enumerate(terms)]
    return read.select(key, *keep, "__len", *times, "__scored", "__bonus"), terms


def _times(term: str) -> Column:
    return F.size(F.filter("__hits", lambda t: t == term))


def scores(counted: DataFrame, terms: list[str], key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of what ``counts`` found, above the least score."""
    stats = counted.agg(
        F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))]
    )
    score = F.col("__bonus")
    for i in range(len(terms)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        score = score + F.when(tf > 0, _part(tf, df, F.col("__len"))).otherwise(F.lit(0.0))
    return counted.filter("__scored").join(F.broadcast(stats)).select(key, *keep, score.alias("raw_score")).filter(F.col("raw_score") > LEAST_SCORE)  # one row


def _part(tf: Column, df: Column, length: Column) -> Column:
    idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / F.col("__avg")))


def index(docs: DataFrame, key: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """An index for several queries of one run: (key, term, tf) and (key, len). ``kept_index`` writes one that lasts.

    Occurrences are counted per row and term before the shuffle.
    """
    read = docs.select(key, F.explode(tokens).alias("term"))
    postings = read.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return postings, docs.select(key, F.size(tokens).cast("long").alias("len"))


def search(postings: DataFrame, lengths: DataFrame, query: list[str], key: str) -> DataFrame:
    """key and raw_score from an index. Terms that the query repeats count as often."""
    weights = {t: query.count(t) for t in query}
    hits = postings.filter(F.col("term").isin(*weights)) if weights else postings.limit(0)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("__df"))
    stats = lengths.agg(F.count(F.lit(1)).alias("__n"), F.avg("len").alias("__avg"))
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(float(n))) for t, n in weights.items()]) if weights else F.lit(0.0)
    joined = hits.join(F.broadcast(df.withColumnRenamed("term", "__t")), F.col("term") == F.col("__t")).join(lengths, key).join(F.broadcast(stats))  # a row a query term; one row
    return joined.groupBy(key).agg(F.sum(weight * _part(F.col("tf"), F.col("__df"), F.col("len"))).alias("raw_score")).filter(F.col("raw_score") > LEAST_SCORE)


def ladder(name: Column, query: str, tokens: list[str], exact: float, inside: float, part: float) -> Column:
    """A bonus if the query is the name, holds it, or has a token of four characters or more that stands in it. An empty name has none."""
    whole, low = query.strip().lower(), F.lower(F.coalesce(name, F.lit("")))
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in dict.fromkeys(tokens) if len(t) >= 4], F.lit(False))
    return F.when(low == "", 0.0).when(low == whole, exact).when(F.contains(F.lit(whole), low), inside).when(some, part).otherwise(0.0)


def code_search(chunks: DataFrame, query: str, key: str, where: Column | None = None) -> DataFrame:
    """key and raw_score of chunks (symbol_name, file_name, relative_path, content) for a query in words or identifiers.

    Symbol, file, path and content are searched as one text in code tokens, with
    bonuses for the symbol's and the file's name. A token that the query repeats counts as often.
    """
    wanted = query_tokens(chunks.sparkSession, query)
    whole = F.concat_ws(" ", F.coalesce("symbol_name", F.lit("")), "file_name", "relative_path", "content")
    bonus = ladder(F.col("symbol_name"), query, wanted, 4.0, 3.0, 2.0) + ladder(F.col("file_name"), query, wanted, 3.0, 2.0, 1.5)
    terms = list(dict.fromkeys(wanted))
    scored = (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("__scored")
    read = chunks.select(key, code_counts(whole, terms).alias("__c"), scored, bonus.cast("double").alias("__bonus"))
    small = settled(read.select(key, F.col("__c.len").alias("__len"), *[F.col("__c.times")[i].alias(f"__tf{i}") for i in range(len(terms))], "__scored", "__bonus"), "bm25")
    stats = small.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))])
    score = F.col("__bonus")
    for i, t in enumerate(terms):
        tf = F.col(f"__tf{i}")
        score = score + F.when(tf > 0, wanted.count(t) * _part(tf, F.col(f"__df{i}"), F.col("__len"))).otherwise(F.lit(0.0))
    return small.filter("__scored").join(F.broadcast(stats)).select(key, score.alias("raw_score")).filter(F.col("raw_score") > LEAST_SCORE)  # one row


def expansions(token: str) -> list[str]:
    """What ``code_tokens`` makes of one token, for tasks that meet each different token once."""
    low = token.lower()
    snake = [p for p in low.split("_") if p] if "_" in token else []
    camel = [p.lower() for p in _CAMEL.findall(token)]
    roots: list[str] = []
    if len(low) > 4:
        if low.endswith("ation"):
            roots = [low[:-5], low[:-5] + "ate"]
        elif low.endswith("ing") and len(low) > 5:
            roots = [low[:-3]]
        elif low.endswith("ed"):
            roots = [low[:-2], low[:-1]]
        elif low.endswith("es"):
            roots = [low[:-2]]
        elif low.endswith("s") and not low.endswith("ss"):
            roots = [low[:-1]]
    return [low, *snake, *(camel if len(camel) > 1 else []), *roots]


def code_counts(text: Column, terms: list[str]) -> Column:
    """A struct of how many code tokens a text has, and how many of each term.

    An expression on arrays would take every occurrence apart again; here a batch takes each different token apart once, and
    occurrences are looked up. Null counts as empty.
    """
    kind = "struct<len:bigint,times:array<bigint>>"

    @F.arrow_udf(kind)
    def count(texts: pa.Array) -> pa.Array:
        known: dict[str, tuple[int, list[int]]] = {}
        lengths, times = [], []
        for value in texts:
            total, found = 0, [0] * len(terms)
            for token, n in Counter(_WORD.findall(value.as_py() or "")).items():
                told = known.get(token)
                if told is None:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    made = expansions(token)
                    told = known[token] = (len(made), [i for t in made for i, term in enumerate(terms) if t == term])
                total += n * told[0]
                for i in told[1]:
                    found[i] += n
            lengths.append(total)
            times.append(found)
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array(times, pa.list_(pa.int64()))], names=["len", "times"])

    return count(text)


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """A query's code tokens, by the same expression as the corpus's."""
    return spark.range(1).select(code_tokens(F.lit(query))).first()[0]


def similar(vectors: DataFrame, query: list[float], key: str, vector: str) -> DataFrame:
    """key and similarity on the shifted scale of rows above the cut; none for an empty query."""
    if not query:
        return vectors.select(key, F.lit(0.0).alias("similarity")).limit(0)
    probe = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, shifted_cosine(F.col(vector), probe).alias("similarity")).filter(F.col("similarity") > LEAST_SIMILARITY)


def top(hits: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` best hits with their rank from 1; ties by key."""
    best = hits.orderBy(F.desc(score), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def normalised(best: DataFrame, score: str, name: str) -> DataFrame:
    """Scores over the largest among all hits. ``best``: what ``top`` left, which has the largest in it."""
    most = F.max(score).over(W.partitionBy())
    return best.withColumn(name, F.when(most > 0, F.col(score) / most).otherwise(F.lit(0.0)))


def fused(left: DataFrame, right: DataFrame, key: str, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank)."""
    a, b = left.select(F.col(key).alias("a_key"), F.col("rank").alias("a_rank")), right.select(F.col(key).alias("b_key"), F.col("rank").alias("b_rank"))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return both.select(F.coalesce("a_key", "b_key").alias(key), "a_rank", "b_rank", (part("a_rank") + part("b_rank")).alias("rrf"))


def hybrid(lexical: DataFrame, vectors: DataFrame, key: str, limit: int) -> DataFrame:
    """key, rank, score, mode of the best ``limit`` of two ranked lists (key, rank, score), each looked at to twice that depth.

    Scores are over the largest. Without any vector hit the lexical list passes
    through, named as such. Ties go to the better lexical, then the better vector rank.
    """
    depth = 2 * limit
    left, right = lexical.filter(F.col("rank") <= depth), vectors.filter(F.col("rank") <= depth)
    both = fused(left, right, key)
    last = F.lit(2 * depth + 1)
    order = [F.desc("rrf"), F.coalesce("a_rank", last), F.coalesce("b_rank", last)]
    best = both.orderBy(*order).limit(limit)  # what is left has ``limit`` rows
    ranked = best.select(key, F.row_number().over(W.orderBy(*order)).alias("rank"), (F.col("rrf") / F.max("rrf").over(W.partitionBy())).alias("score"), F.lit("hybrid").alias("mode"))
    none = right.agg((F.count(F.lit(1)) == 0).alias("__none"))
    plain = left.filter(F.col("rank") <= limit).select(key, "rank", "score", F.lit("lexical_fallback").alias("mode"))
    every = ranked.withColumn("__of", F.lit(False)).unionByName(plain.withColumn("__of", F.lit(True)))
    return every.join(F.broadcast(none), F.col("__of") == F.col("__none")).select(key, "rank", "score", "mode")  # one row


def capabilities(chunks: DataFrame, vector: str) -> DataFrame:
    """One row: how many chunks there are, how many have a vector, and which searches that allows."""
    n, with_vector = F.count(F.lit(1)), F.count_if(F.size(F.coalesce(F.col(vector), F.array())) > 0)
    seen = chunks.agg(n.alias("chunks"), with_vector.alias("vectors"))
    return seen.select("chunks", "vectors", (F.col("chunks") > 0).alias("lexical"), (F.col("vectors") > 0).alias("semantic"), F.when(F.col("chunks") == 0, "NOT_INDEXED").when(F.col("vectors") > 0, "HYBRID").otherwise("LEXICAL").alias("status"))


@dataclass
class Answer:
    """``results``: key, rank, score, mode; ``report``: one row with mode_requested, mode_used, status, results, warning."""

    results: DataFrame
    report: DataFrame


def by_mode(mode: str, chunks: DataFrame, vector: str, lexical: DataFrame, semantic: DataFrame, key: str, limit: int) -> Answer:
    """A search in the mode that is asked for, and an honest word on which one answered.

    ``lexical`` and ``semantic``: ranked lists (key, rank, score), to twice ``limit``; ``chunks``: what is indexed, with its column of vectors. Modes are lexical,
    semantic and hybrid; any other is lexical. Semantic search without vectors has no result and says so, it never passes lexical hits off as its own; hybrid
    search without vectors is named lexical_fallback. Without any chunk all modes keep their name and have no result.
    """
    asked = mode.strip().lower()
    asked = asked if asked in ("lexical", "semantic", "hybrid") else "lexical"
    seen = capabilities(chunks, vector)
    able = F.broadcast(seen.select(F.col("semantic").alias("__semantic"), F.col("lexical").alias("__lexical")))  # one row
    if asked == "hybrid":
        results = hybrid(lexical.join(able).filter("__lexical").select(key, "rank", "score"), semantic.join(able).filter("__semantic").select(key, "rank", "score"), key, limit)
    else:
        listed, need = (lexical, "__lexical") if asked == "lexical" else (semantic, "__semantic")
        results = listed.filter(F.col("rank") <= limit).join(able).filter(need).select(key, "rank", "score", F.lit(asked).alias("mode"))
    used = F.when((F.lit(asked) == "hybrid") & F.col("lexical") & ~F.col("semantic"), "lexical_fallback").otherwise(asked)
    warning = F.when(~F.col("lexical"), "nothing is indexed").when((F.lit(asked) != "lexical") & ~F.col("semantic"), "no chunk has a vector")
    count = F.broadcast(results.agg(F.count(F.lit(1)).alias("results")))  # one row
    return Answer(results, seen.join(count).select(F.lit(mode).alias("mode_requested"), used.alias("mode_used"), "status", "results", warning.alias("warning")))
