"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import appended, slices

WIDTH = 1024
N = 3
#: Documents bundled at a time, and n-grams whose vectors are in memory at a time.
ROWS, GRAMS = 128, 4096
UNKNOWN = "und"


@lru_cache(maxsize=1 << 16)
def letter(point: int) -> np.ndarray:
    """The random +1/-1 vector of a letter; its code point is the seed."""
    return np.random.default_rng([6, point]).integers(0, 2, WIDTH, np.int8) * np.int8(2) - np.int8(1)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For each code point: itself lower-cased if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(points: np.ndarray) -> np.ndarray:
    """Keys of the n-grams of one text's letters; runs of other characters are one space, at the edges too."""
    folded = np.concatenate([[32], _is_letter()[points], [32]]).astype(np.uint64)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    folded = folded[keep]
    if len(folded) < N:
        return np.zeros(0, np.uint64)
    return folded[:-2] << np.uint64(42) | folded[1:-1] << np.uint64(21) | folded[2:]


def gram_vectors(keys: np.ndarray) -> np.ndarray:
    """Each n-gram's vector: its letters' vectors, rotated by their distance from the end, multiplied."""
    out = np.ones((len(keys), WIDTH), np.int8)
    for place in range(N):
        points = (keys >> np.uint64(21 * (N - 1 - place)) & np.uint64(0x1FFFFF)).astype(np.int64)
        distinct, which = np.unique(points, return_inverse=True)
        turned = np.stack([np.roll(letter(int(p)), N - 1 - place) for p in distinct])
        out *= turned[which]
    return out


def bundled(texts: list[str]) -> np.ndarray:
    """The summed n-gram vectors of each whole text; all zero without a letter."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for at in range(0, len(texts), ROWS):
        some = texts[at : at + ROWS]
        found = [grams(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for t in some]
        owner = np.repeat(np.arange(len(some)), [len(f) for f in found])
        if not len(owner):
            continue
        keys, which = np.unique(np.concatenate(found), return_inverse=True)
        for lo in range(0, len(keys), GRAMS):
            mine = (which >= lo) & (which < lo + GRAMS) if len(keys) > GRAMS else slice(None)
            width = min(GRAMS, len(keys) - lo)
            counts = np.bincount(owner[mine] * width + which[mine] - lo, minlength=len(some) * width)
            out[at : at + len(some)] += counts.reshape(len(some), width).astype(np.float32) @ gram_vectors(keys[lo : lo + width]).astype(np.float32)
    return out


@dataclass
class Prototypes:
    languages: list[str]
    vectors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with the largest cosine (ties: the first by name) and that cosine, at least 0."""
        vectors = bundled(texts)
        norms = np.linalg.norm(vectors, axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = (vectors @ self.vectors.T) / np.maximum(norms, 1e-9)[:, None]
        best = cosines.argmax(axis=1)
        known = norms > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Prototypes:
    """Language prototypes from every row of ``docs`` whose lang is not null.

    A prototype is the sum of its documents' vectors, each at unit length, so a few
    very long ones do not decide it. Tasks add up per language; WIDTH numbers per
    language and task are shuffled, and WIDTH per language come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "body"):
            vectors = bundled(_texts(batch.column("body")))
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
            codes = batch.column("language").dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(codes.dictionary.to_pylist()):
                sums[name] = sums.get(name, 0) + vectors[which == i].sum(axis=0, dtype=np.float64)
        if sums:
            names = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["language", "v"])

    read = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("language"), F.col(text).alias("body"))
    parts = read.mapInArrow(run, "language string, v array<double>").select("language", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("language", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("language").collect()
    vectors = np.array([[x["x"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), WIDTH)
    real = np.linalg.norm(vectors, axis=1) > 0
    vectors = vectors[real]
    return Prototypes([r["language"] for r, ok in zip(rows, real, strict=True) if ok], (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).round(6).astype(np.float32))


def identified(docs: DataFrame, prototypes: Prototypes, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(prototypes)  # WIDTH floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            names, scores = sent.value.predict(_texts(batch.column(text)))
            yield appended(batch, **{pred: pa.array(names, pa.string()), score: pa.array(scores, pa.float64())})

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, train_on, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang_pred, lang_score of every row; languages are learned where ``train_on`` (a Column) holds.

    Repeated rows get equal results. Without any labelled row everything is ``und``.
    A very long text is read whole in one task, which holds some 40 bytes for each of its
    letters meanwhile. An empty table gives no row. Other columns are not looked at.
    """
    prototypes = fit(docs.filter(train_on).select(text, lang), text, lang)
    return identified(docs.select(key, text), prototypes, text).select(key, "lang_pred", "lang_score")
