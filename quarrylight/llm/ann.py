"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph and a classifier that routes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import settled
from quarrylight.llm.vectors import comparable, matrix

#: Graph and classifier are fitted on so many vectors at most, the first by a hash of the id.
SAMPLE = 8192
NEIGHBOURS, HIDDEN = 10, 128
#: Partitions of one router: one for about so many rows, a power of two within these bounds. Of more rows each partition gets a router of its own.
PART_ROWS, MIN_PARTS, MAX_PARTS = 16_384, 16, 256
#: Recall that the probes must reach on sample queries that the fit did not train on; with two levels each must reach its root.
GOAL = 0.94
#: Rows of a partition that are searched as one block.
ROWS = 32_768


def neighbour_graph(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` other rows with the largest inner product, for each row."""
    k = min(k, len(rows) - 1)
    out = np.empty((len(rows), k), np.int64)
    for at in range(0, len(rows), 1024):
        s = rows[at : at + 1024] @ rows.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """2^depth parts of near equal size with few edges between them.

    Recursive bisection: the second eigenvector of the random walk by power
    iteration, cut at its median, then swaps between the sides while a swap
    of the best on each side lowers the cut.
    """
    n = len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    for _ in range(depth):
        inner = part[a] == part[b]
        u, v = a[inner], b[inner]
        degree = np.maximum(np.bincount(u, minlength=n), 1)
        value = rng.normal(size=n)
        for _ in range(60):
            value = 0.5 * value + 0.5 * np.bincount(u, value[v], n) / degree
            mass = np.bincount(part, degree * value)[part] / np.maximum(np.bincount(part, degree), 1)[part]
            value -= mass
            value /= np.sqrt(np.bincount(part, degree * value * value))[part] + 1e-300
        order = np.lexsort((np.arange(n), value, part))
        size = np.bincount(part)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        side = (rank >= (size[part] + 1) // 2).astype(np.int64)
        for _ in range(8):
            across = np.bincount(u, side[u] != side[v], n)
            gain = 2 * across - degree
            moved = 0
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                sides = [mine[side[mine] == s] for s in (0, 1)]
                sides = [s[np.argsort(-gain[s], kind="stable")] for s in sides]
                m = min(map(len, sides))
                good = np.flatnonzero(gain[sides[0][:m]] + gain[sides[1][:m]] > 2)
                good = good[: max(1, len(good) // 2)] if len(good) else good
                for s, other in ((0, 1), (1, 0)):
                    side[sides[s][good]] = other
                moved += len(good)
            if not moved:
                break
        part = 2 * part + side
    return part


@dataclass
class Router:
    """A classifier with one hidden layer from a vector to the partitions, and how many to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    probes: int = 0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(rows / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(rows: np.ndarray, share: np.ndarray, rng: np.random.Generator, epochs: int = 30) -> Router:
    """Cross-entropy against each row's share of neighbours per partition, by Adam on batches."""
    scale = float(np.sqrt((rows * rows).mean())) or 1.0
    width, k = rows.shape[1], share.shape[1]
    params = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, k)), np.zeros(k)]
    moments, step = [[np.zeros_like(p), np.zeros_like(p)] for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 256):
            i = order[at : at + 256]
            x = rows[i] / scale
            h = np.maximum(x @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - share[i]) / len(i)
            back = (g @ params[2].T) * (h > 0)
            step += 1
            for value, grad, (m, v) in zip(params, (x.T @ back, back.sum(0), h.T @ g, g.sum(0)), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Router(*params, scale)


def fit(rows: np.ndarray, parts: int, top: int, seed: int = 3, goal: float | None = None) -> Router:
    """A router for ``parts`` partitions, with probes that reach ``goal`` (GOAL) on held-out sample rows."""
    goal = GOAL if goal is None else goal
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(rows))[: min(512, len(rows) // 8)]
    learned = np.delete(rows, held, axis=0) if len(held) else rows
    graph = neighbour_graph(learned, NEIGHBOURS)
    part = balanced_parts(graph, parts.bit_length() - 1, rng)
    share = np.zeros((len(learned), parts))
    np.add.at(share, (np.arange(len(learned)), part), 1.0)
    for column in graph.T:
        np.add.at(share, (np.arange(len(learned)), part[column]), 1.0)
    router = train_router(learned, share / share.sum(1, keepdims=True), rng)
    router.probes = parts
    if len(held) and len(learned) > 4 * top:
        placed = router.logits(learned).argmax(1)
        rank = np.argsort(np.argsort(-router.logits(rows[held]), axis=1), axis=1)
        truth = np.argpartition(-(rows[held] @ learned.T), top - 1, axis=1)[:, :top]
        needed = np.take_along_axis(rank, placed[truth], axis=1)
        found = np.array([(needed < p).mean() for p in range(1, parts + 1)])
        router.probes = max(2, int(np.argmax(found >= goal)) + 1)
    return router


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, top: int, marks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query, id, score) and the query's mark: each query's ``top`` best rows of a block, by score and then smaller id."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    marks = query_ids if marks is None else marks
    length = np.linalg.norm(rows, axis=1).max(initial=0)
    for at in range(0, len(queries), 128):
        q, own = queries[at : at + 128], query_ids[at : at + 128]
        s = q @ rows.T
        s[ids == own[:, None]] = -np.inf
        k = min(top, len(rows))
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        # Rounding differs with a row's place in the product: all who come that near are taken and scored one way.
        slack = 1e-12 * (1 + np.linalg.norm(q, axis=1) * length)
        for i in range(len(q)):
            near = np.flatnonzero((s[i] >= least[i] - slack[i]) & np.isfinite(s[i]))
            score = (rows[near] * q[i]).sum(axis=1)
            order = np.lexsort((ids[near], -score))[:top]
            out[0].append(np.full(len(order), own[i]))
            out[1].append(ids[near][order])
            out[2].append(score[order])
            out[3].append(np.full(len(order), marks[at + i]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


@dataclass
class Routers:
    """A router, and for many rows one more for each of its partitions: partitions are numbered through."""

    first: Router
    parts: int
    inner: dict[int, Router] | None = None
    inner_parts: int = 1

    def placed(self, rows: np.ndarray) -> np.ndarray:
        """The likeliest partition of each row."""
        part = self.first.logits(rows).argmax(1)
        out = part * self.inner_parts
        for p in np.unique(part) if self.inner else ():
            mine = np.flatnonzero(part == p)
            if p in self.inner:
                out[mine] += self.inner[p].logits(rows[mine]).argmax(1)
        return out.astype(np.int32)

    def probed(self, row: np.ndarray, counts: np.ndarray, top: int) -> list[int]:
        """The partitions that a query is sent to: the likeliest, as many as sufficed, and on until they hold more than ``top`` rows."""
        order, out, held = np.argsort(-self.first.logits(row[None])[0], kind="stable"), [], 0
        for n, p in enumerate(order):
            if n >= self.first.probes and held > top:
                break
            router = self.inner.get(int(p)) if self.inner else None
            inner = np.argsort(-router.logits(row[None])[0], kind="stable") if router else np.zeros(1, np.int64)
            for m, q in enumerate(inner):
                if router and m >= router.probes and held > top:
                    break
                part = int(p) * self.inner_parts + int(q)
                if counts[part]:
                    out.append(part)
                    held += int(counts[part])
        return out


def learned(good: DataFrame, rows: int, width: int, top: int, seed: int) -> Routers:
    """Routers fitted on bounded samples, the first rows by a hash of the id: one of all rows, and beyond MAX_PARTS partitions of PART_ROWS rows one of each partition, by tasks."""
    spark = good.sparkSession
    deep = rows > MAX_PARTS * PART_ROWS
    goal = GOAL**0.5 if deep else GOAL
    parts = 1 << max(MIN_PARTS, min(MAX_PARTS, rows // PART_ROWS)).bit_length() - 1
    sample = good.select("id", "vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).toArrow()
    routers = Routers(fit(matrix(sample["vector"], width), parts, top, seed, goal), parts)
    if not deep:
        return routers
    each = rows // parts
    routers.inner_parts = 1 << max(2, min(MAX_PARTS, each // PART_ROWS)).bit_length() - 1
    sent, inner_parts = spark.sparkContext.broadcast(routers.first), routers.inner_parts
    share = min(1.0, 4 * SAMPLE / max(each, 1))  # of a partition's rows; even one of a quarter of the mean fills its sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = sent.value.logits(matrix(batch.column("vector"), width)).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    def train(table: pa.Table) -> pa.Table:
        router = fit(matrix(table.sort_by([("h", "ascending"), ("id", "ascending")])["vector"], width), inner_parts, top, seed, goal)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "router": [pickle.dumps(router)]})

    some = good.select("id", "vector", F.xxhash64("id", F.lit(seed + 1)).alias("h")).filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    schema = T.StructType([*some.schema.fields, T.StructField("part", T.IntegerType())])
    first = W.partitionBy("part").orderBy("h", "id")
    kept = some.mapInArrow(place, schema).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE).drop("r")
    # At most MAX_PARTS routers of (width + MAX_PARTS) * HIDDEN numbers.
    made = kept.groupBy("part").applyInArrow(train, "part int, router binary").collect()
    routers.inner = {r["part"]: pickle.loads(r["router"]) for r in made}
    return routers


def search(vectors: DataFrame, is_query: Column, top: int = 20, key: str = "vec_id", vector: str = "embedding", seed: int = 3) -> DataFrame:
    """query_id, rank, key, score: for each query row its ``top`` nearest other rows found, by inner product.

    Every row is put into the partition that the router finds likeliest; a query
    goes to its likeliest partitions, as many as the fit found sufficient, and on until they hold more than ``top``
    rows. There all rows are scored exactly in double precision. Partitions of
    many rows are cut into blocks; a task holds one copy of a block and its queries pass by in batches, and each block returns
    ``top`` rows a query. Partitions grow in number with the rows, over two levels of routers.

    Rows whose vector is null, zero or not finite, or of another length than most,
    and rows without a key take no part. Rows that repeat as a whole count once, as queries and as candidates; a query's own row (equal key) is no
    candidate. Ties go to the smaller key. A very long list costs its length in every row; lists of the common length are read whole. A
    query with fewer candidates gets them all; an empty table gives no row. Other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    read = vectors.withColumn("asks", F.coalesce(is_query, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), "asks")
    good = settled(read.filter(F.col("id").isNotNull() & comparable("vector")).distinct(), "vectors")
    widths = good.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    empty = spark.createDataFrame([], T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())]))
    if widths is None:
        return empty
    width, rows = widths["w"], widths["count"]
    good = good.filter(F.size("vector") == width)
    routers = learned(good, rows, width, top, seed)
    sent = spark.sparkContext.broadcast(routers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = sent.value.placed(matrix(batch.column("vector"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    placed = settled(good.mapInArrow(place, T.StructType([*good.schema.fields, T.StructField("part", T.IntegerType())])), "placed")
    counts = np.zeros(routers.parts * routers.inner_parts, np.int64)  # a number a partition
    for r in placed.groupBy("part").count().collect():
        counts[r["part"]] = r["count"]
    cuts = np.maximum(1, -(-counts // ROWS))
    starts = np.concatenate([[0], np.cumsum(cuts)])
    blocks = int(starts[-1])
    known = spark.sparkContext.broadcast((counts, cuts, starts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to a block of their partition, by a hash."""
        _, cuts, starts = known.value
        for batch in batches:
            part, mark = batch.column("part").to_numpy(), batch.column("uid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((starts[part] + mark % cuts[part]).astype(np.int32)), *[batch.column(c) for c in ("asks", "uid", "id", "vector")]], names=["block", "asks", "uid", "id", "vector"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to all blocks of their partitions."""
        counts, cuts, starts = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                own, block = [], []
                for i, row in enumerate(matrix(some.column("vector"), width)):
                    for p in sent.value.probed(row, counts, top):
                        block += range(int(starts[p]), int(starts[p] + cuts[p]))
                        own += [i] * int(cuts[p])
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *[some.column(c).take(pa.array(own, pa.int64())) for c in ("asks", "uid", "id", "vector")]], names=["block", "asks", "uid", "id", "vector"])

    kind = placed.schema["vector"].dataType.simpleString()
    schema = f"block int, asks boolean, uid long, id long, vector {kind}"
    named = placed.withColumn("uid", F.xxhash64("id", "vector"))
    both = named.withColumn("asks", F.lit(False)).mapInArrow(deal, schema).unionByName(named.filter("asks").select("asks", "uid", "id", "vector").mapInArrow(send, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted, a block's rows before its queries."""
        now, held, ids, block = None, [], None, None
        for batch in batches:
            blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (asks[1:] != asks[:-1])) + 1), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                piece = batch.slice(a, b - a)
                if blocks[a] != now:
                    now, held, block = blocks[a], [], None
                if not asks[a]:
                    held.append(piece)
                    continue
                if block is None and held:
                    rows = pa.Table.from_batches(held)
                    held, ids, block = [], rows["id"].to_numpy(), matrix(rows["vector"], width)
                if block is not None:
                    uids = piece.column("uid").to_numpy()
                    q, i, s, u = best_in_block(matrix(piece.column("vector"), width), piece.column("id").to_numpy(), block, ids, top, uids)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["uid", "query_id", "id", "score"])

    found = both.repartition(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(run, "uid long, query_id long, id long, score double")
    best = W.partitionBy("query_id", "uid").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
