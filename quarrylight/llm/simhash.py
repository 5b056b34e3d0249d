"""SimHash fingerprints of word shingles and near-duplicate groups by covering LSH."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import settled
from quarrylight.llm.components import components

BITS = 64
#: Shingles hashed at a time: bounds what a very long text needs.
CHUNK = 1 << 16
#: Near texts: minwise symbols of a sketch, symbols that make a block, and how often what failed with one hub tries another.
SYMBOLS, BLOCK, HUBS = 40, 4, 3
#: Texts are compared if at least LIKELY of their symbols agree (at a similarity of 0.8 some 32 do, fewer than 24 in 0.2 % of cases); while fewer than SURE do, another hub is tried.
LIKELY, SURE = 24, 34
#: Texts that meet a copy of their hub in one part: a hub's text is sent as often as it has parts.
PART = 64
#: Hashes of texts that are needed are broadcast while they are no more than this (some 50 MB); beyond it texts are shuffled to find them.
BROADCAST_TEXTS = 1 << 20
#: Prefixes of similar texts share so many shingles; of one text in SAMPLED the most frequent shingles are learned, FREQUENT at most. They say only in which order shingles are taken.
SHARED, SAMPLED, FREQUENT = 3, 32, 1 << 16
#: Longs of a set's mark: they tell sets of some 500 shingles apart before a pair of them is a row.
MARKS = 4
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text, as an unsigned integer; 0 if it has no word.

    Words are maximal runs without ASCII white space after A-Z are lower-cased; a
    shingle is ``shingle`` words joined by spaces, repeats included, or the whole
    sequence if it is shorter. A bit is set if it is in over half of the hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        some = [digest(joined[i:j], seed) for i, j in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without its text, with ``simhash`` long: the 64 bits as a signed number."""
    kept = [c for c in docs.columns if c != text]
    names = [*kept, "simhash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            found = [fingerprint(x.as_py(), shingle, seed) for x in batch.column(at)]
            prints = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, prints], names=names)

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("simhash", T.LongType())])
    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 masks such that two numbers within ``radius`` bits agree under at least one.

    Every bit position gets a nonzero vector of radius+1 bits (Pagh, 2016). The
    mask of a nonzero vector a holds the positions whose vector has an odd product
    with a. At most ``radius`` differing positions span less than the whole space,
    so some a is orthogonal to all of them, and its mask hides them all.
    """
    size = 1 << (radius + 1)
    masks = []
    for a in range(1, size):
        masks.append(sum(1 << i for i in range(BITS) if bin(a & (i % (size - 1) + 1)).count("1") % 2))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_prints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (left, right) between distinct fingerprints; their closure is that of all pairs within ``radius``.

    ``prints``: one column ``simhash`` without repeats. Table t buckets the
    fingerprints under mask t, and only buckets of two or more go on. A bucket may
    hold a large group, so its pairs are never listed: two members are within
    2r' bits if and only if they meet at a number within r' bits of both, in the
    positions outside the mask. Members are dealt by those meeting numbers and
    each is linked to the smallest it meets there, which keeps rows linear. For an
    even radius all who meet are within it, so no link is lost and none is added.
    An odd radius is checked on the pairs of a meeting, at most BITS of them each.
    """
    masks = covering_masks(radius)
    reach = (radius + 1) // 2
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("simhash").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    dealt = prints.select("simhash", table.alias("x")).select("simhash", "x.t", "x.key")
    shared = dealt.groupBy("t", "key").agg(F.min("simhash").alias("lo"), F.max("simhash").alias("hi"))
    shared = shared.filter("lo <> hi").select(F.col("t").alias("t2"), F.col("key").alias("key2"))
    members = dealt.join(shared, (F.col("t") == F.col("t2")) & (F.col("key") == F.col("key2")), "left_semi")
    flips = []
    for m in masks:
        free = [i for i in range(BITS) if not m >> i & 1]
        flips.append([_signed(sum(1 << i for i in c)) for k in range(reach + 1) for c in combinations(free, k)])
    by_table = F.array(*[F.array(*[F.lit(f) for f in some]) for some in flips])
    meeting = members.select("simhash", "t", F.explode(F.element_at(by_table, F.col("t") + 1)).alias("flip"))
    meeting = meeting.select("simhash", "t", F.col("simhash").bitwiseXOR(F.col("flip")).alias("z"))
    if radius % 2 == 0:
        hubs = meeting.groupBy("t", "z").agg(F.min("simhash").alias("left"), F.collect_set("simhash").alias("all"))
        pairs = hubs.filter(F.size("all") > 1).select("left", F.explode("all").alias("right"))
        return pairs.filter("left <> right").distinct()
    met = meeting.groupBy("t", "z").agg(F.collect_set("simhash").alias("all")).filter(F.size("all") > 1)
    pairs = met.select("all", F.explode("all").alias("left")).select("left", F.explode("all").alias("right"))
    near = F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= radius
    return pairs.filter((F.col("left") < F.col("right")) & near).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: key, simhash long, component_id (smallest key in its group).

    Null and empty texts have fingerprint 0 and are linked like any other. Equal
    texts and repeated rows share a fingerprint and so a group. A null key belongs
    to its group but is never its component_id unless no key there is set. An empty
    table gives an empty result. A very long text is held whole in one task, with its
    words as a list; its shingles are hashed in portions. Columns other than key and
    text are not looked at.
    """
    marked = settled(fingerprints(docs.select(key, text), text, shingle, seed), "simhash")
    classes = settled(marked.groupBy("simhash").agg(F.min(key).alias("least")), "prints")
    linked = components(linked_prints(classes.select("simhash"), radius), "left", "right")
    rooted = classes.join(linked, F.col("simhash") == F.col("node"), "left")
    rooted = rooted.select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest.withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
    named = named.select(F.col("simhash").alias("print"), "component_id")
    return marked.join(named, F.col("simhash") == F.col("print")).select(key, "simhash", "component_id")


def hex_print(simhash: str = "simhash"):
    return F.lower(F.lpad(F.hex(F.col(simhash)), 16, "0"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _A
    x = (x ^ x >> np.uint64(29)) * _B
    return x ^ x >> np.uint64(32)


def shingle_hashes(text: str | None, shingle: int = 5, seed: int = 42) -> tuple[np.ndarray, bytes]:
    """64-bit hashes of a text's shingles, repeats included, and one of 128 bits of its whole sequence of words; empty without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), b""
    known = {w: xxhash.xxh64_intdigest(w, seed) for w in set(words)}
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    whole = xxhash.xxh3_128_digest(b" ".join(words), seed)
    n, width = max(1, len(words) - shingle + 1), min(shingle, len(words))
    made = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            made = _mixed(made * _A + one[k : k + n])
    return made, whole


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least of the distinct shingles under each of SYMBOLS orders, as unsigned numbers."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), CHUNK // 4):
            least = np.minimum(least, (shingles[at : at + CHUNK // 4, None] * _MULTIPLIERS).min(axis=0))
    return least


def simhash_of(shingles: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), CHUNK):
        counts += np.unpackbits(shingles[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0])


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """key, print (of the text), digest (of its words), simhash, blocks and symbols (a byte each) for (key, text, print) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, blocks, symbols = [], [], [], []
            for x in batch.column(1):
                made, whole = shingle_hashes(x.as_py(), shingle)
                digests.append(whole)
                prints.append(simhash_of(made))
                keys = sketch(np.unique(made)).reshape(-1, BLOCK)
                symbols.append((keys.ravel() >> np.uint64(16)).astype(np.uint8).tobytes())
                with np.errstate(over="ignore"):
                    joined = keys[:, 0]
                    for k in range(1, BLOCK):
                        joined = _mixed(joined) + keys[:, k]
                blocks.append(joined.view(np.int64).tolist() if whole else [])
            hashes = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), hashes, pa.array(blocks, pa.list_(pa.int64())), pa.array(symbols, pa.binary())], names=["key", "print", "digest", "simhash", "blocks", "symbols"])

    key = T.StructField("key", docs.schema["key"].dataType)
    return docs.select("key", "text", "print").mapInArrow(run, T.StructType([key, T.StructField("print", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("simhash", T.LongType()), T.StructField("blocks", T.ArrayType(T.LongType())), T.StructField("symbols", T.BinaryType())]))


def _buckets(members: DataFrame) -> DataFrame:
    """bucket, n, digest of the members (digest, t, block) of buckets that hold more than one."""
    placed = members.select(F.xxhash64("t", "block").alias("bucket"), "digest")
    sized = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return placed.join(sized, "bucket").select("bucket", "n", "digest")


def _hub_edges(shared: DataFrame) -> DataFrame:
    """bucket, left, hub: each member of a bucket and the one that shares most blocks with all others."""
    popular = shared.groupBy("digest").agg(F.sum("n").alias("popular"))
    best = shared.join(popular, "digest").groupBy("bucket").agg(F.max_by("digest", F.struct("popular", "digest")).alias("hub"))
    return shared.select("bucket", F.col("digest").alias("left")).join(best, "bucket").filter("left <> hub")


def _agreeing(edges: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of ``edges`` (left, right) with ``agree``: how many symbols of both are the same."""
    a = sketches.select(F.col("digest").alias("left"), F.hex("symbols").alias("a"))
    b = sketches.select(F.col("digest").alias("right"), F.hex("symbols").alias("b"))
    same = [(F.substring("a", 2 * i + 1, 2) == F.substring("b", 2 * i + 1, 2)).cast("int") for i in range(SYMBOLS)]
    return edges.join(a, "left").join(b, "right").select("left", "right", reduce(lambda x, y: x + y, same).alias("agree"))


def _bodies(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """digest, text of the texts that ``needed`` (print, digest) names, once each."""
    few = needed.count() <= BROADCAST_TEXTS
    found = rows.select("print", "text").join(F.broadcast(needed) if few else needed, "print")
    return found.groupBy("digest").agg(F.min("text").alias("text"))


def _alike(edges: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The (left, right) rows of ``edges`` whose texts' sets of shingles have a Jaccard similarity of ``least`` or more.

    ``texts``: digest, text, one row each. A hub may have any share of all edges, so
    its text goes to one part for each PART of them.
    """
    parts = edges.groupBy("right").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = edges.join(parts, "right").withColumn("part", F.pmod(F.xxhash64("left"), F.col("parts")).cast("int")).select("left", "right", "part")
    hubs = texts.select(F.col("digest").alias("right"), F.col("text").alias("b")).join(parts, "right").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("right", "part", "b")
    near = dealt.join(texts.select(F.col("digest").alias("left"), F.col("text").alias("a")), "left")
    both = near.join(hubs, ["right", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, hub, of_hub = [], None, None
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                if hub is None or not b.equals(hub):
                    hub, of_hub = b, np.unique(shingle_hashes(b.as_py(), shingle)[0])
                own = np.unique(shingle_hashes(a.as_py(), shingle)[0])
                shared = len(np.intersect1d(own, of_hub, assume_unique=True))
                chosen.append(shared >= least * (len(own) + len(of_hub) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["left", "right"]).filter(pa.array(chosen, pa.bool_()))

    return both.select("left", "right", "a", "b").mapInArrow(run, "left binary, right binary")


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and the power of two of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x.as_py(), shingle)[0]).view(np.int64))], names=["token"])

    some = rows.filter(F.pmod("print", F.lit(SAMPLED)) == 0).groupBy("print").agg(F.min("text").alias("text")).select("text")
    often = some.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = often.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, counts = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.log2(counts[order]).astype(np.int8)


def prefix(shingles: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first of a set's shingles in one order for all sets, the frequent ones last.

    Two sets of sizes m and n with a Jaccard similarity of ``least`` share o of the shingles, and o is ``least`` times
    the larger size at least. Whatever the order, the first m - o + k of one and n - o + k of the other share k (k no more than o).
    """
    known, levels = frequent if frequent is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int8))
    level = np.zeros(len(shingles), np.int8)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        level = np.where(known[at] == shingles, levels[at] + 1, 0)
    need = int(np.ceil(least * len(shingles) - 1e-6))
    return shingles[np.lexsort((shingles, level))][: len(shingles) - need + min(SHARED, need)]


def mark(shingles: np.ndarray) -> np.ndarray:
    """MARKS longs: of each class of shingles whether the set holds an odd number.

    A shingle that only one of two sets holds changes one bit at most, so their marks differ in no more bits than there are such shingles.
    """
    odd = np.bincount((shingles % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _missed(rows: DataFrame, classes: DataFrame, rooted: DataFrame, shingle: int, least: float) -> DataFrame:
    """(left, right): every pair of texts of different ``rooted`` groups (digest, root) that may be as similar as ``least``.

    Shingles that only texts of one group have in their prefixes are left out, so a large group
    of copies lists no pairs; what is left of it are texts of its kind that are not in it. Two sets of sizes m and n that are so similar
    differ in (m + n) (1 - least) / (1 + least) shingles at most; pairs whose marks differ in more bits do not leave the join. Nothing else is left out.
    """
    frequent = _frequent(rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)[0]) for x in batch.column(1)]
            tokens = pa.array([prefix(x, least, frequent).view(np.int64) for x in sets], pa.list_(pa.int64()))
            marks = pa.array([mark(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), tokens, marks], names=["print", "size", "tokens", "marks"])

    reps = classes.select("digest", F.col("print").alias("of"))
    found = rows.select("print", "text").mapInArrow(run, "print long, size long, tokens array<long>, marks array<long>").join(reps, F.col("print") == F.col("of"))
    once = found.groupBy("digest").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("marks").alias("marks"))  # rows of one text are equal
    numbered = settled(once.withColumn("id", F.monotonically_increasing_id()), "prefixes")
    ids = settled(numbered.select("digest", "id").join(rooted, "digest").select("digest", "id", "root"), "ids")
    roots = ids.join(ids.select(F.col("digest").alias("of"), F.col("id").alias("group")), F.col("root") == F.col("of")).select(F.col("id").alias("mine"), "group")
    placed = settled(numbered.select("id", "size", "tokens").join(roots, F.col("id") == F.col("mine")).select("id", "group", "size", "tokens"), "placed").select("id", "group", "size", F.explode("tokens").alias("token"))
    mixed = placed.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("token")
    marks = [f"mark{k}" for k in range(MARKS)]
    marked = numbered.select(F.col("id").alias("of"), *[F.col("marks")[k].alias(c) for k, c in enumerate(marks)])
    met = settled(settled(placed.join(mixed, "token", "left_semi"), "mixed").join(marked, F.col("id") == F.col("of")).drop("of"), "met")
    other = met.select("token", *[F.col(c).alias(f"{c}2") for c in ("id", "group", "size", *marks)])
    fits = (F.col("group") != F.col("group2")) & (F.col("id") < F.col("id2")) & (F.least("size", "size2") >= least * F.greatest("size", "size2") - 1e-6)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in marks])
    fits &= apart <= (F.col("size") + F.col("size2")) * ((1 - least) / (1 + least)) + 1e-6
    both = met.join(other, "token").filter(fits).groupBy("id", "id2").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("size", "size2")).alias("m"))
    pairs = both.filter(F.col("n") >= F.least(F.lit(SHARED), F.ceil(least * F.col("m") - 1e-6))).select("id", "id2")
    a = ids.select(F.col("id").alias("a"), F.col("digest").alias("left"))
    b = ids.select(F.col("id").alias("b"), F.col("digest").alias("right"))
    return settled(pairs.join(a, F.col("id") == F.col("a")).join(b, F.col("id2") == F.col("b")).select("left", "right"), "missed")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: key, print (xxhash64 of the text), component: the smallest (key, print) of its group.

    Texts are linked if their sets of word shingles have a Jaccard similarity of
    ``least`` or more, which is checked on the texts themselves. Candidates come
    from two sketches. SimHashes within ``radius`` bits meet under the covering
    masks, but at a similarity of 0.8 they differ in some 9 of 64 bits, too many
    for masks to cover. So SYMBOLS minwise hashes, cut into blocks of BLOCK, serve
    as well: texts that differ in fewer symbols than there are blocks share a block. No
    pairs are listed: texts of one bucket are compared with a hub, the one that
    shares most blocks, and where some differ, with another, HUBS times in all. How
    many symbols agree says which texts are worth reading.

    What sketches miss comes from an exact join: similar texts share some of the first shingles in any one order, so every pair
    of different groups that does so is compared on the texts too. No link between groups is lost.

    Equal sequences of words, told apart by 128 bits, are one class from the start; texts without a word are
    one group. Null keys come last among equals. Repeated rows are rows of one
    group. A very long text is held whole in one task. An empty table gives no row.
    Other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    marked = settled(_sketched(rows, shingle), "sketched")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "print")
    classes = settled(marked.groupBy("digest").agg(F.min(order).alias("least"), F.min_by(F.struct("simhash", "blocks", "symbols"), "print").alias("s"), F.min("print").alias("print")).select("digest", "least", "print", "s.*"), "texts")
    of_print = settled(classes.filter(F.size("blocks") > 0).groupBy("simhash").agg(F.min("digest").alias("digest")), "prints")
    same = classes.join(of_print.withColumnRenamed("digest", "right"), "simhash").select(F.col("digest").alias("left"), "right").filter("left <> right")
    masked = linked_prints(of_print.select("simhash"), radius)
    masked = masked.join(of_print.select(F.col("simhash").alias("left"), F.col("digest").alias("l")), "left").join(of_print.select(F.col("simhash").alias("right"), F.col("digest").alias("r")), "right").select(F.col("l").alias("left"), F.col("r").alias("right"))
    shared = settled(_buckets(classes.select("digest", F.posexplode("blocks").alias("t", "block"))), "shared")
    sketches = settled(classes.select("digest", "symbols"), "symbols")
    found = [settled(_agreeing(same.unionByName(masked).distinct(), sketches), "agreeing")]
    for turn in range(HUBS):
        hubs = settled(_hub_edges(shared), "hubs")
        edges = hubs.select("left", F.col("hub").alias("right")).distinct()
        found.append(settled(_agreeing(edges, sketches), "agreeing"))
        # Where a bucket holds texts that its hub may not link, all but the hub try again.
        linked = found[-1].filter(F.col("agree") >= SURE).select("left", F.col("right").alias("hub"))
        failed = hubs.join(linked, ["left", "hub"], "left_anti").select("bucket").distinct()
        again = hubs.join(failed, "bucket", "left_semi").select(F.lit(turn).alias("t"), F.col("bucket").alias("block"), F.col("left").alias("digest"))
        shared = settled(_buckets(again), "shared")
        if shared.isEmpty():
            break
    def read(edges: DataFrame) -> DataFrame:
        # Only texts with a likely partner are read again.
        ids = edges.select(F.col("left").alias("digest")).union(edges.select("right")).distinct()
        needed = settled(ids.join(classes.select("digest", "print"), "digest").select("print", "digest"), "needed")
        return settled(_alike(edges, settled(_bodies(rows, needed), "bodies"), shingle, least), "alike")

    edges = settled(reduce(DataFrame.unionByName, found).filter(F.col("agree") >= LIKELY).select("left", "right").distinct(), "candidates")
    roots = components(read(edges), "left", "right")
    rooted = settled(classes.join(roots, F.col("digest") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "digest").alias("root")), "rooted")
    of = rooted.select(F.col("digest").alias("of"), F.col("root").alias("group"))
    more = read(_missed(rows, classes, rooted.select("digest", "root"), shingle, least))
    more = more.join(of, F.col("left") == F.col("of")).select("right", F.col("group").alias("a")).join(of, F.col("right") == F.col("of")).select("a", F.col("group").alias("b"))
    joined = components(more, "a", "b")
    rooted = rooted.join(joined.withColumnRenamed("root", "top"), F.col("root") == F.col("node"), "left").select("digest", "least", F.coalesce("top", "root").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(smallest, "root").select("digest", "component")
    return marked.join(named, "digest").select(F.col("key").alias(key), "print", F.struct(F.col("component.key").alias(key), "component.print").alias("component"))
