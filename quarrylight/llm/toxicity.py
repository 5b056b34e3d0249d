"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import appended, row_sums, settled, slices, word_codes

#: Rows of the embedding table that words and their character n-grams are hashed to.
BUCKETS = 1 << 17
#: The training sample: so many documents of each class at most, the first by a hash of the id; 32 million characters in all, shared in proportion.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 2000, 4000, 32_000_000
NGRAMS = (3, 4, 5)
#: Neutral words that every average holds besides the text's own, so that a few rare words do not decide a short text.
PRIOR_WORDS = 5
PORTION = 1 << 14
EDGES = ".,;:!?\"'()[]{}<>*#%&$|~`_-+=/\\…“”‘’«»¡¿"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bare(word: str) -> str:
    """The word without punctuation at its edges; empty if no letter or digit is left."""
    word = word.strip(EDGES)
    return word if any(c.isalnum() for c in word) else ""


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, and each word's offset into them.

    A word loses punctuation at its edges and is put between angle brackets; its
    subwords are the whole and its character n-grams. A word without letters or
    digits has none. Words go in portions, which bounds the arrays in between.
    """
    made = [_subwords(words[at : at + PORTION]) for at in range(0, len(words), PORTION)] or [_subwords([])]
    counts = np.concatenate([n for _, n in made])
    return np.concatenate([b for b, _ in made]), np.concatenate([[0], np.cumsum(counts)])


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w}>" if w else "" for w in map(bare, words)]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(NGRAMS) + 1):
            if len(points) < n:
                break
            rolled = rolled[: len(points) - n + 1] * np.uint64(1_000_003) + points[n - 1 :] + np.uint64(n)
            if n in NGRAMS:
                inside = owner[: len(rolled)] == owner[n - 1 :]
                found.append(rolled[inside])
                owners.append(owner[: len(rolled)][inside])
        starts = np.cumsum(sizes) - sizes
        spot = np.arange(len(points)) - np.repeat(starts, sizes)
        power = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 6_364_136_223_846_793_005, np.uint64))
        whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(7)) * power[spot])])
        some = np.flatnonzero(sizes)
        found.append(whole[starts[some] + sizes[some]] - whole[starts[some]])
        owners.append(some)
        keys, owners = np.concatenate(found), np.concatenate(owners)
        keys = (keys ^ keys >> np.uint64(29)) * _MIX
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    buckets = (keys >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)[order]
    return buckets, counts


@dataclass
class Model:
    """What scoring needs of embeddings and softmax: each bucket's margin toward toxic, and the bias."""

    margins: np.ndarray
    bias: float

    def word_margins(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, offsets = subwords(words)
        counts = np.diff(offsets)
        return row_sums(self.margins[buckets], offsets) / np.maximum(counts, 1), counts > 0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """One probability a text; texts without words get that of the bias alone."""
        words, codes, offsets = word_codes(texts)
        margins, real = self.word_margins(words) if words else (np.zeros(0), np.zeros(0, bool))
        total, n = row_sums(margins[codes], offsets), row_sums(real[codes].astype(float), offsets)
        return 1 / (1 + np.exp(-np.clip(total / (n + PRIOR_WORDS) + self.bias, -60, 60)))


def train(texts: pa.Array | pa.ChunkedArray | list[str], toxic: np.ndarray, prior: float, width: int = 4, epochs: int = 120, rate: float = 0.1, gain: float = 20.0, decay: float = 2e-5, seed: int = 4) -> Model:
    """Fits embeddings and softmax together by full-batch Adam on the cross-entropy.

    A document is the mean over its words (and PRIOR_WORDS neutral ones) of the mean
    over their subwords' vectors, times ``gain``. ``prior`` is the share of toxic rows among all labelled rows; the
    bias is moved from the sample's share to it. One class alone gives a constant.
    """
    y = np.asarray(toxic, float)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), base)
    read = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string())
    known: dict[str, int] = {}
    parts, sizes, at = [], np.full(len(read), PRIOR_WORDS), 0
    for piece in slices([pa.record_batch([read], names=["text"])]):  # a slice's words are held at a time
        found, codes, offsets = word_codes(piece.column("text"))
        of = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
        real = np.array([bool(bare(w)) for w in found], bool)[codes]
        doc = np.repeat(np.arange(at, at + len(piece)), np.diff(offsets))[real]
        sizes[at : at + len(piece)] += np.bincount(doc - at, minlength=len(piece))
        pairs, times = np.unique(doc << 32 | of[codes[real]], return_counts=True)
        parts.append((pairs, times.astype(np.int32)))
        at += len(piece)
    words = list(known)
    pairs, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    doc, word = pairs >> 32, pairs & 0xFFFFFFFF
    # A word of one document only teaches nothing about others. Subwords are made for the rest alone.
    common = np.bincount(word, minlength=len(words)) > 1
    doc, word, share = (x[common[word]] for x in (doc, word, times / sizes[doc]))
    word = (np.cumsum(common) - 1)[word]
    buckets, spans = subwords([w for w, c in zip(words, common, strict=True) if c])
    counts = np.diff(spans)
    del words, known, parts, pairs, times
    by_word = 1 / np.maximum(counts, 1)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (BUCKETS, width)).astype(np.float32), rng.normal(0, 0.5, (width, 2)).astype(np.float32), np.zeros(2, np.float32)]
    table, soft, bias = params
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, epochs + 1):
        # With two classes the softmax needs only the difference of their logits.
        margins = table @ (soft[:, 1] - soft[:, 0])
        per_word = row_sums(margins[buckets], spans) * by_word
        logit = gain * np.bincount(doc, share * per_word[word], len(texts)) + bias[1] - bias[0]
        g = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) / len(y)
        per_word = np.bincount(word, share * (gain * g)[doc], len(counts)) * by_word
        per_bucket = np.bincount(buckets, per_word[owner], BUCKETS).astype(np.float32)
        toward = np.stack([-per_bucket, per_bucket], 1)
        grads = [toward @ soft.T + decay * table, table.T @ toward, np.array([-g.sum(), g.sum()], np.float32)]
        for value, grad, (m, v) in zip(params, grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    used = np.unique(buckets)
    held = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    margins = gain * (table @ (soft[:, 1] - soft[:, 0]))
    unseen = np.ones(BUCKETS, bool)
    unseen[used] = False
    margins[unseen] = 0
    return Model(margins.astype(np.float32), float(bias[1] - bias[0]) + base - float(np.log(held / (1 - held))))


def sample(sizes: DataFrame, y: int, most: int, chars: int, seed: int) -> list[tuple]:
    """(id, print) of whole texts of class ``y``, in the order of the ids' hashes, within ``most`` texts and ``chars`` characters.

    ``sizes``: id, y, size, print. A text that no longer fits is passed over and the
    next is looked at. The driver reads no more rows at a time than it can still
    take, ids and lengths alone.
    """
    left = sizes.filter(F.col("y") == y).withColumn("h", F.xxhash64("id", F.lit(seed))).select("h", "id", "size", "print")
    got: list[tuple] = []
    after = None
    while len(got) < most and chars > 0:
        more = left.filter(F.col("size") <= chars)
        if after is not None:
            more = more.filter((F.col("h") > after[0]) | (F.col("h") == after[0]) & (F.col("id") > after[1]))
        wanted = most - len(got)
        rows = more.orderBy("h", "id").limit(wanted).collect()
        for r in rows:
            if r["size"] <= chars:
                got.append((r["id"], r["print"]))
                chars -= r["size"]
        if len(rows) < wanted:
            break
        after = (rows[-1]["h"], rows[-1]["id"])
    return got


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 4) -> Model:
    """A model from labelled rows, of which a bounded sample of whole texts (see the module's constants) is read.

    ``labels``: key and label; null keys and labels take no part. The sample is the
    rows of each class with the smallest hash of the key, so it does not depend on
    how the table is stored. Lengths are looked at first: only the texts that fit
    their class's share of the characters are brought to the driver.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    text_of = F.coalesce(F.col(text), F.lit(""))
    body = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), text_of.alias("body"))
    # One document an id, so repeated ids cannot outgrow the bound.
    least = body.groupBy("k").agg(F.min(F.struct(F.length("body").alias("size"), F.xxhash64("body").alias("print"))).alias("x"))
    sizes = settled(least.join(known, F.col("k") == F.col("id")).select("id", "y", "x.size", "x.print"), "sizes")
    each = MOST_CHARS // (MOST_TOXIC + MOST_CLEAN)
    rows = [(i, p, y) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)) for i, p in sample(sizes, y, most, most * each, seed)]
    spark = docs.sparkSession
    chosen = spark.createDataFrame(rows, T.StructType([T.StructField("id", sizes.schema["id"].dataType), T.StructField("print", T.LongType()), T.StructField("y", T.IntegerType())]))
    read = body.join(F.broadcast(chosen), (F.col("k") == F.col("id")) & (F.xxhash64("body") == F.col("print"))).select("k", "y", "body")  # MOST_TOXIC + MOST_CLEAN rows at most
    got = read.groupBy("k", "y").agg(F.min("body").alias("body")).toArrow().sort_by("k")
    total = sum(shares.values())
    return train(got["body"], got["y"].to_numpy(), shares.get(1, 0) / total if total else 0.5, seed=seed)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with ``name`` double, from the whole text alone; null and empty texts get the prior's score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # one float a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield appended(batch, **{name: pa.array(sent.value.scores(batch.column(text)), pa.float64())})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, train_on, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and toxicity of every row of ``docs``; labels are learned where ``train_on`` (a Column over key) holds.

    Repeated rows get equal scores. Without any usable label every score is that of
    an even prior. A very long text is scored whole, a slice of its own in one task, with
    its words as an array of numbers. An empty table gives no row. Other columns are not
    looked at.
    """
    model = fit(docs, labels.filter(train_on), key, text)
    return scored(docs.select(key, text), model, text).select(key, "toxicity")
