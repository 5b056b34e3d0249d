"""Near-duplicate vectors: inverted lists, product-quantised residuals, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import settled
from quarrylight.llm.components import components
from quarrylight.llm.vectors import comparable, kmeans, matrix, nearest

#: The quantisers are fitted on so many distinct vectors at most, the first by a hash of the id.
SAMPLE = 16_384
SUBSPACES, CODES = 8, 64
#: Lists are as many as the square root of the vectors, within these bounds; so many neighbouring ones make a group, to which a query goes once.
MIN_LISTS, MAX_LISTS, GROUP = 64, 1024, 16
#: Members and queries of a group that meet in one task at a time.
MEMBERS, QUERIES = 2048, 4096
SLACK = 1e-6


@dataclass
class Quantiser:
    """Coarse centres, and for each subspace of the residual its code vectors. Works on unit vectors."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]
    #: Each list's group.
    groups: np.ndarray

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the exact distance between each row and what its codes stand for."""
        own, _ = nearest(rows, self.centres)
        rest = rows - self.centres[own]
        codes = np.stack([nearest(rest[:, a:b], book)[0] for (a, b), book in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def probes(self, rows: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """(row, list): every list up to the row's own that may hold a vector within ``reach``.

        A vector x of list c is at least as near to c as to the row's centre o. Moving
        by ``reach`` changes the difference of the squared distances to c and o by
        2 * reach * |c - o| at most, so a row beyond that has no such x. Of a pair
        in two lists, the member of the later list probes the earlier.
        """
        _, d = nearest(rows, self.centres)
        apart = np.sqrt(np.maximum(nearest(self.centres, self.centres)[1], 0))[own]
        able = d - d[np.arange(len(rows)), own][:, None] <= 2 * reach * apart + SLACK
        able &= np.arange(len(self.centres)) <= own[:, None]
        able[np.arange(len(rows)), own] = True
        return np.argwhere(able)

    def tables(self, queries: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each query's residual parts to all code vectors: query, subspace, code."""
        rest = queries - self.centres[at]
        return np.stack([nearest(rest[:, a:b], book)[1] for (a, b), book in zip(self.cuts, self.books, strict=True)], 1)


def fit(rows: np.ndarray, lists: int = MIN_LISTS, seed: int = 8) -> Quantiser:
    rng = np.random.default_rng(seed)
    centres = kmeans(rows, max(1, min(lists, len(rows) // 16)), 8, rng)
    rest = rows - centres[nearest(rows, centres)[0]]
    width = rows.shape[1]
    edges = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
    cuts = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    books = [kmeans(rest[:, a:b], min(CODES, len(rows)), 6, rng) for a, b in cuts]
    hubs = kmeans(centres, -(-len(centres) // GROUP), 8, rng)
    return Quantiser(centres, books, cuts, nearest(centres, hubs)[0].astype(np.int32))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest of the nodes 0..n-1."""
    parent = list(range(n))
    chosen = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[b] = a
            chosen.append(i)
    return np.array(chosen, np.int64)


def meet(quantiser: Quantiser, width: int, threshold: float, members: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between a group's members and queries: (id, id of a link kept for the closure or -1, whether it is a link, links counted)."""
    x, q = matrix(members["vector"], width), matrix(queries["q_vector"], width)
    x_id, q_id = members["rep"].to_numpy(), queries["q_rep"].to_numpy()
    x_w, q_w = members["weight"].to_numpy(), queries["q_weight"].to_numpy()
    codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
    reach = np.sqrt(2 - 2 * threshold) + members["error"].to_numpy() + SLACK
    lists, own = members["list"].to_numpy(), queries["q_list"].to_numpy()
    probes = queries["q_probes"].combine_chunks()
    probed, asks = probes.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(probes.offsets.to_numpy()))
    x_norm, q_norm, unit = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1), _unit(q)
    x_links, q_links = np.zeros(len(x), np.int64), np.zeros(len(q), np.int64)
    lefts, rights = [], []
    for at in np.unique(lists).tolist():
        held, asking = np.flatnonzero(lists == at), asks[probed == at]
        for lo in range(0, len(asking), 128):
            some = asking[lo : lo + 128]
            tables = quantiser.tables(unit[some], at)
            far = sum(tables[:, i][:, codes[held, i]] for i in range(codes.shape[1]))
            near = far <= reach[held] * reach[held]
            # Of two members of one list the greater asks the smaller.
            near &= (own[some] != at)[:, None] | (x_id[held] < q_id[some, None])
            i, j = np.nonzero(near)
            i, j = some[i], held[j]
            for part in range(0, len(i), 1 << 16):
                a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                cosine = (q[a] * x[b]).sum(1) / (q_norm[a] * x_norm[b])
                a, b = a[cosine >= threshold], b[cosine >= threshold]
                q_links += np.bincount(a, x_w[b], len(q)).astype(np.int64)
                x_links += np.bincount(b, q_w[a], len(x)).astype(np.int64)
                keep = _forest(len(q) + len(x), a, len(q) + b)
                lefts.append(a[keep])
                rights.append(b[keep])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (lefts, rights))
    keep = _forest(len(q) + len(x), a, len(q) + b)
    some_q, some_x = np.flatnonzero(q_links), np.flatnonzero(x_links)
    ids = np.concatenate([q_id[a[keep]], q_id[some_q], x_id[some_x]])
    others = np.concatenate([x_id[b[keep]], np.full(len(some_q) + len(some_x), -1)])
    is_edge = np.arange(len(ids)) < len(keep)
    return ids, others, is_edge, np.concatenate([np.zeros(len(keep), np.int64), q_links[some_q], x_links[some_x]])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, seed: int = 8) -> DataFrame:
    """key, n_links, component_id, kept for every row of ``vectors``.

    Vectors of equal label are linked at a cosine of ``threshold`` or more. Equal
    vectors of a label become one class with a weight first, so copies are never
    expanded into pairs. Each class is indexed under its nearest coarse centre with
    the codes of its residual, and queries all lists that can hold a neighbour
    (``Quantiser.probes``). The table-lookup distance prunes: it differs from the
    true distance by the stored coding error at most, so no link is lost, and what
    is left is checked by the exact cosine in double precision. Lists grow in number
    with the vectors. Neighbouring ones make a group, and a query is sent once to
    each group that it asks; long groups are cut into chunks of members and of
    queries. A task returns counts and a spanning forest.

    Rows that are null, empty, zero or not finite, or whose label or key is null,
    link with nothing and are kept. Vectors of different length never link. Rows of
    one key are one node; a repeated row is one more vector. Any number of vectors of one
    label is dealt to chunks of bounded size. An empty table gives no row. Other columns
    are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & comparable("vector")
    good = rows.filter(valid).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")).cast(rows.schema["vector"].dataType))
    good = settled(good.withColumn("h", F.xxhash64("label", "vector")), "vectors")
    classes = good.groupBy("h", "label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = settled(classes, "classes")
    width, n = classes.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    if width is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.select("rep", "vector").orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(SAMPLE).toArrow()
    quantiser = fit(_unit(matrix(sample["vector"], width)), max(MIN_LISTS, min(MAX_LISTS, int(n**0.5))), seed)
    sent = spark.sparkContext.broadcast(quantiser)  # MAX_LISTS + CODES vectors at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(matrix(batch.column("vector"), width))
            own, codes, error = sent.value.encode(unit)
            probed = sent.value.probes(unit, own, np.sqrt(2 - 2 * threshold))
            # One entry for each group that a row asks: its number and the lists.
            of = sent.value.groups[probed[:, 1]]
            order = np.lexsort((probed[:, 1], of, probed[:, 0]))
            row, group, asked = probed[order, 0], of[order], probed[order, 1]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
            firsts = np.flatnonzero(fresh)
            inner = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(row)), pa.int32()), pa.array(asked, pa.int32()))
            entries = pa.StructArray.from_arrays([pa.array(group[firsts], pa.int32()), inner], names=["group", "lists"])
            asks = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[firsts], np.arange(len(unit) + 1)), pa.int32()), entries)
            made = [pa.array(own, pa.int32()), pa.array(sent.value.groups[own], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), asks]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "list", "group", "codes", "error", "asks"])

    entry = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))])
    fields = [T.StructField("list", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("error", T.DoubleType()), T.StructField("asks", T.ArrayType(entry))]
    of = classes.select("rep", "weight", "label", F.size("vector").alias("width"), "vector")
    indexed = settled(of.mapInArrow(index, T.StructType([*of.schema.fields, *fields])), "index")
    where = ["label", "width", "group"]
    sizes = indexed.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("x_parts"))
    calls = indexed.select("label", "width", F.explode("asks.group").alias("group")).groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_parts"))
    parts = settled(sizes.join(calls, where), "parts")
    deal = lambda parts: F.pmod(F.xxhash64("rep", "weight"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    group = [*where, "x_part", "q_part"]
    left = indexed.drop("asks").join(parts, where).withColumn("x_part", deal("x_parts")).withColumn("q_part", every("q_parts"))
    left = left.select(*group, "list", "rep", "weight", "vector", "codes", "error")
    right = indexed.select("rep", "weight", "label", "width", "vector", "list", F.explode("asks").alias("ask")).withColumn("group", F.col("ask.group")).withColumn("probes", F.col("ask.lists")).join(parts, where)
    right = right.withColumn("q_part", deal("q_parts")).withColumn("x_part", every("x_parts"))
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in (*group, "rep", "weight", "vector", "list", "probes")])

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            ids = others = links = np.zeros(0, np.int64)
            is_edge = np.zeros(0, bool)
        else:
            ids, others, is_edge, links = meet(sent.value, width, threshold, members, queries)
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(others, pa.int64()), "edge": is_edge, "links": links})

    met = left.groupBy(*group).cogroup(right.groupBy(*[f"q_{c}" for c in group])).applyInArrow(run, "a long, b long, edge boolean, links long")
    met = settled(met, "met")
    links = met.filter("not edge").groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    roots = components(met.filter("edge"), "a", "b")
    known = classes.select(F.col("h").alias("h2"), F.col("label").alias("label2"), F.col("vector").alias("vector2"), "rep", "weight")
    known = known.join(links, F.col("rep") == F.col("linked"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    same = (F.col("h") == F.col("h2")) & (F.col("label") == F.col("label2")) & (F.col("vector") == F.col("vector2"))
    n_links = F.col("weight") - 1 + F.coalesce(F.col("links"), F.lit(0))
    found = good.join(known, same).select("id", n_links.cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    alone = rows.filter(~valid | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.unionByName(alone).select(F.col("id").alias(key), "n_links", F.col("component_id"), kept.alias("kept"))
