"""Cross-entropy difference between matched target and background n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import row_sums, settled, slices, word_codes

#: Distinct n-grams of slices that one bucket adds up, about: the number of buckets grows with the corpus.
BUCKET = 1 << 20
#: Slices whose n-grams a bucket adds up at once: of more, groups of so many are added up first, so that a word of every slice is no more numbers in a bucket.
SPREAD = 1 << 14
#: Target keys are sent to all tasks while they are no more than this (64 MB of sorted numbers); beyond it texts and keys meet by a sort-merge join.
BROADCAST_KEYS = 1 << 23
#: Pseudo-counts that pull a pair's probability to its word's, and a word's to even.
TO_WORD, TO_EVEN = 8.0, 0.1
#: The hash that stands before the first word.
START = np.uint64(0x9FB21C651E98DF25)
_A, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
#: Bits of a hash beyond those that number all n-grams: about one in 2^SPARE shares its hash with another, at any size of corpus.
SPARE = 20
#: What is counted of an n-gram: occurrences in all rows and in target rows, and the same of words as contexts.
KINDS = 4


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(kind)


def among(keys: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Which keys are among sorted ones; nulls are not."""
    found = pc.fill_null(keys.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(wanted, found), max(len(wanted) - 1, 0))
    return (wanted[at] == found if len(wanted) else np.zeros(len(found), bool)) & keys.is_valid().to_numpy(zero_copy_only=False)


def slice_table(docs: DataFrame, key_type: T.DataType, wanted: Broadcast | None = None) -> DataFrame:
    """Rows (key, body, target) in slices of some megabytes: words as hashes, texts as indexes into them. ``wanted``: the sorted target keys, if ``target`` does not say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, "body")):
            words, codes, offsets = word_codes(batch.column("body"))
            real = np.array([bool(w) for w in words], bool)
            inside = real[codes]
            lengths = np.diff(np.concatenate([[0], np.cumsum(inside)])[offsets]).astype(np.int64)
            word = (np.cumsum(real) - 1)[codes[inside]].astype(np.int64)
            hashes = word_hashes([w for w in words if w])
            target = (batch.column("target").to_numpy(zero_copy_only=False) if wanted is None else among(batch.column("key"), wanted.value)).astype(np.int64)
            columns = {
                "slice": [first + i], "n_rows": [len(lengths)], "n_words": [len(word)], "n_distinct": [len(hashes)],
                "n_target": [int((lengths * target).sum())], "starts": [int((lengths > 0).sum())], "starts_target": [int(((lengths > 0) * target).sum())],
                "lengths": [packed(lengths)], "targets": [packed(target)], "words": [packed(word)], "hashes": [packed(hashes)],
            }
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key"))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(v) for v in columns.values()]], names=["keys", *columns])

    longs = ["slice", "n_rows", "n_words", "n_distinct", "n_target", "starts", "starts_target"]
    fields = [T.StructField("keys", T.ArrayType(key_type)), *[T.StructField(c, T.LongType()) for c in longs]]
    fields += [T.StructField(c, T.BinaryType()) for c in ("lengths", "targets", "words", "hashes")]
    return docs.mapInArrow(run, T.StructType(fields))


class Slice:
    """A slice read back: for each word its document, itself, the one before it, and its pair, as indexes.

    ``keys`` holds the distinct n-grams as hashes of ``bits`` bits and a last one that
    tells words (0) from pairs, words first, and ``order`` sorts them.
    """

    def __init__(self, row: dict, bits: int):
        n, words, distinct = row["n_rows"], row["n_words"], row["n_distinct"]
        self.lengths, self.target = unpacked(row["lengths"], n), unpacked(row["targets"], n).astype(bool)
        self.word, hashes = unpacked(row["words"], words), unpacked(row["hashes"], distinct, np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.doc = np.repeat(np.arange(n), self.lengths)
        self.distinct = distinct
        before = np.concatenate([[distinct], self.word[:-1]]) if words else self.word.copy()
        before[self.offsets[:-1][self.lengths > 0]] = distinct
        self.before = before
        pairs, self.pair = np.unique(before * np.int64(max(distinct, 1)) + self.word, return_inverse=True)
        with np.errstate(over="ignore"):
            left = np.append(hashes, START)[pairs // max(distinct, 1)] * _A
            both = np.concatenate([hashes, left + hashes[pairs % max(distinct, 1)]]) >> np.uint64(64 - bits) << _PAIR
        self.keys = both | (np.arange(len(both)) >= distinct).astype(np.uint64)
        self.order = np.argsort(self.keys)

    def counts(self) -> np.ndarray:
        """KINDS counts of each key."""
        found = np.zeros((KINDS, len(self.keys)), np.int64)
        inside = self.target[self.doc]
        for part, chosen in ((0, slice(None)), (1, inside)):
            found[part, : self.distinct] = np.bincount(self.word[chosen], minlength=self.distinct)
            found[part, self.distinct :] = np.bincount(self.pair[chosen], minlength=len(self.keys) - self.distinct)
            found[part + 2, : self.distinct] = np.bincount(self.before[chosen], minlength=self.distinct + 1)[:-1]
        return found


def own_counts(doc: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each occurrence, how often its document has the same value."""
    size = np.int64(found.max(initial=0) + 1)
    _, which, n = np.unique(doc * size + found, return_inverse=True, return_counts=True)
    return n[which]


def losses(pairs: np.ndarray, words: np.ndarray, contexts: np.ndarray, whole: np.ndarray, vocabulary: int, scale: float = 1.0) -> np.ndarray:
    """Negative log probability of words after those before them, by counts that leave out their own document.

    Counts are multiplied by ``scale``. After any word the probabilities of the
    ``vocabulary`` words add up to one.
    """
    alone = (scale * words + TO_EVEN) / (scale * whole + TO_EVEN * vocabulary)
    return -np.log((scale * pairs + TO_WORD * alone) / (scale * contexts + TO_WORD))


def _keys(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.cumsum(unpacked(x, n, np.uint64), dtype=np.uint64) for x, n in zip(table["asked"].to_pylist(), table["n"].to_pylist(), strict=True)])


def asks(keys: np.ndarray, counts: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, n, keys, counts) of the buckets that sorted keys fall to by their hashes."""
    of = (keys >> np.uint64(bits + 1 - 32)) * np.uint64(buckets) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(of)) + 1
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
        if i < j:
            yield int(of[i]), j - i, packed(np.diff(keys[i:j], prepend=np.uint64(0))), packed(counts[:, i:j])


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of some asks, sorted, the sums of their counts, and which key each row of the asks is."""
    sizes = table["n"].to_pylist()
    keys, which = np.unique(_keys(table), return_inverse=True)
    counts = np.concatenate([unpacked(x, KINDS * n).reshape(KINDS, n) for x, n in zip(table["counts"].to_pylist(), sizes, strict=True)], axis=1)
    return keys, np.stack([np.bincount(which, c, len(keys)) for c in counts]).astype(np.int64), which  # sums in doubles: exact below 2^53


def _answers(table: pa.Table, found: np.ndarray, of: list[str]) -> pa.Table:
    """Each ask with its part of the totals of all rows."""
    sizes = table["n"].to_pylist()
    made = [packed(found[:, j - n : j]) for n, j in zip(sizes, np.cumsum(sizes).tolist(), strict=True)]
    return table.select(of).append_column("totals", pa.array(made, pa.binary()))


ASKED = "bucket long, n long, asked binary, counts binary"


def totals(cut: DataFrame, buckets: int, bits: int, slices_: int = 0) -> tuple[DataFrame, DataFrame]:
    """The counts over all slices of each slice's n-grams of a bucket (slice, bucket, n, totals), in the order of their hashes, and one row with the number of different words.

    A slice sends each of its distinct n-grams once, with its counts, to the bucket
    that its hash names, so a frequent word is one number a slice. A bucket adds
    them up and answers each slice in the order in which it asked.

    Of more than ``SPREAD`` slices, groups of that many are added up first, in wider buckets: a group then
    asks the buckets as a slice would and answers its slices. So no bucket has more numbers of one word than a group has
    slices, or there are groups, and the hottest word is shared out.
    """
    groups = -(-slices_ // SPREAD) if slices_ > SPREAD else 1
    wide = max(1, -(-buckets // groups))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Slice(row, bits)
                some = list(asks(part.keys[part.order], part.counts()[:, part.order], wide if groups > 1 else buckets, bits))
                own = [pa.array([row["slice"]] * len(some), pa.int64()), pa.array([xxhash.xxh64_intdigest(str(row["slice"])) % groups] * len(some), pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *map(_column, range(4), [some] * 4)], names=["slice", "of", "bucket", "n", "asked", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        _, found, which = _added(table)
        return _answers(table, found[:, which], ["slice", "bucket", "n"])

    def words(table: pa.Table) -> pa.Table:
        return pa.table({"words": pa.array([int((np.unique(_keys(table)) & _PAIR == 0).sum())], pa.int64())})

    asked = cut.drop("keys").mapInArrow(ask, f"slice long, of long, {ASKED}")
    vocabulary = lambda of: of.applyInArrow(words, "words long").agg(F.coalesce(F.sum("words"), F.lit(1)).alias("vocabulary"))
    if groups == 1:
        # Both read one exchange: Spark sees that it is the same and shuffles what slices ask once.
        by = asked.drop("of").groupBy("bucket")
        return by.applyInArrow(answer, "slice long, bucket long, n long, totals binary"), vocabulary(by)

    def gather(table: pa.Table) -> pa.Table:
        """A group's asks of a wide bucket as its own asks of the buckets in it."""
        keys, found, _ = _added(table)
        some = list(asks(keys, found, buckets, bits))
        own = [pa.array([table[c][0].as_py()] * len(some), pa.int64()) for c in ("of", "bucket")]
        return pa.table([*own, *map(_column, range(4), [some] * 4)], names=["of", "wide", "bucket", "n", "asked", "counts"])

    def share(left: pa.Table, right: pa.Table) -> pa.Table:
        """A group's answers handed on to its slices; both know the keys by their order."""
        right = right.sort_by("bucket")
        found = np.concatenate([unpacked(x, KINDS * n).reshape(KINDS, n) for x, n in zip(right["totals"].to_pylist(), right["n"].to_pylist(), strict=True)], axis=1)
        _, which = np.unique(_keys(left), return_inverse=True)
        return _answers(left, found[:, which], ["slice", "bucket", "n"])

    def answer_groups(table: pa.Table) -> pa.Table:
        _, found, which = _added(table)
        return _answers(table, found[:, which], ["of", "wide", "bucket", "n"])

    first = settled(asked, "asked")
    by = settled(first.groupBy("of", "bucket").applyInArrow(gather, f"of long, wide long, {ASKED}"), "gathered").groupBy("bucket")
    told = by.applyInArrow(answer_groups, "of long, wide long, bucket long, n long, totals binary")
    shared = first.drop("counts").groupBy("of", "bucket").cogroup(told.groupBy("of", "wide")).applyInArrow(share, "slice long, bucket long, n long, totals binary")
    return shared, vocabulary(by)


def _column(i: int, rows: list[tuple]) -> pa.Array:
    return pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.binary())


def scored(cut: DataFrame, answers: DataFrame, vocabulary: DataFrame, sums: dict[str, int], bits: int, key_type: T.DataType) -> DataFrame:
    """key, n_words, target_loss, background_loss, difference for every row of every slice."""
    names = ["key", "n_words", "target_loss", "background_loss", "difference"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["keys"]).to_pylist()[0]
        part = Slice(row, bits)
        right = right.sort_by("bucket")
        found = [unpacked(x, KINDS * n).reshape(KINDS, n) for x, n in zip(right["totals"].to_pylist(), right["n"].to_pylist(), strict=True)]
        counts = np.zeros((KINDS, len(part.keys)), np.int64)
        if found:
            counts[:, part.order] = np.concatenate(found, axis=1)
        words, pairs = counts[:, : part.distinct], counts[:2, part.distinct :]
        contexts = np.concatenate([words[2:], [[sums["starts"]], [sums["starts_target"]]]], axis=1)
        own = [own_counts(part.doc, x) for x in (part.pair, part.word, part.before)] + [part.lengths[part.doc]]
        inside = part.target[part.doc]
        by = []
        matched = sums["n_words"] / max(sums["n_target"], 1)
        for kind, whole, scale in ((1, sums["n_target"], matched), (0, sums["n_words"], 1.0)):
            seen = (pairs[kind][part.pair], words[kind][part.word], contexts[kind][part.before], whole)
            by.append(losses(*[a - (np.where(inside, b, 0) if kind else b) for a, b in zip(seen, own, strict=True)], row["vocabulary"], scale))
        means = [row_sums(x, part.offsets) / np.maximum(part.lengths, 1) for x in (*by, by[0] - by[1])]
        keys = pc.list_flatten(left["keys"])
        return pa.table([keys, pa.array(part.lengths), *map(pa.array, means)], names=names)

    schema = T.StructType([T.StructField("key", key_type), T.StructField("n_words", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names[2:]]])
    # One number goes with every slice.
    return cut.join(F.broadcast(vocabulary)).groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, target_loss, background_loss, difference for every row of ``docs``.

    The target corpus is the rows whose key is in ``targets``, the background all
    rows. Losses are means over the words of the whole text, by bigram models that
    leave out the document's own counts; difference is target minus background, so
    lower is nearer to the target. The models are matched: they share the
    vocabulary of all rows, over which the probabilities after a word add up to
    one, the smoothing, and the size, as target counts are scaled to the background's sum.

    Every word and every pair of neighbours is counted as such, by a hash whose width
    grows with the corpus (``SPARE``).
    What is counted grows with the corpus and stays on the executors: slices of
    documents ask buckets of n-grams for their counts. Whole-numbered target keys go to all tasks as sorted numbers if
    they are no more than ``BROADCAST_KEYS``, which saves a shuffle of all texts, and are joined
    by a sort-merge otherwise; beside those numbers the driver sees a few sums. A very long text is a
    slice of its own in one task.

    Null and empty texts have no word: 0 words, losses and difference 0. Null keys
    are background only. Repeated rows count each time and get equal scores. Other
    columns are not looked at.
    Without any target row the target model is even over the vocabulary. An empty
    table gives no row.
    """
    wanted = settled(targets.filter(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct(), "targets")
    kind = docs.schema[key].dataType
    few = isinstance(kind, T.IntegralType) and wanted.count() <= BROADCAST_KEYS
    read, sent = docs.select(F.col(key).alias("key"), F.col(text).alias("body")), None
    if few:
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.select(F.col("id").cast("long")).toArrow()["id"].to_numpy()))
        marked = read.withColumn("target", F.lit(False))
    else:
        marked = read.join(wanted.hint("merge"), F.col("key") == F.col("id"), "left").select("key", "body", F.col("id").isNotNull().alias("target"))
    cut = settled(slice_table(marked, kind, sent), "slices")
    names = ("n_words", "n_target", "starts", "starts_target")
    sums = cut.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.coalesce(F.sum(F.col("n_words") + F.col("n_distinct")), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("slices")).first().asDict()
    bits = min(63, max(40, sums["most"].bit_length() + SPARE))
    answers, vocabulary = totals(cut, max(1, -(-sums["most"] // BUCKET)), bits, sums["slices"])
    return scored(cut, answers, vocabulary, sums, bits, kind).withColumnRenamed("key", key)
