"""Hard-negative mining: ball trees per partition, searched by branch and bound on inner products from above and below."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.llm.common import settled
from quarrylight.llm.vectors import matrix

#: Rows of a partition's trees, the least number of partitions, rows of a leaf, and anchors that search a tree at a time.
PART_ROWS, MIN_PARTS, LEAF, ANCHORS = 32_768, 16, 128, 256
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)
NONE, FAR = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors; ``NONE`` where one does not fit 64 bits."""
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    exact = whole(anchors) @ whole(rows).T if rows.shape[1] else np.zeros((len(anchors), len(rows)), object)
    return np.array([[v if NONE < v <= FAR else NONE for v in row] for row in exact], np.int64).reshape(exact.shape)


class Tree:
    """A ball tree over whole-numbered vectors: node 0 is the root, and a leaf's rows are neighbours in ``rows``."""

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        spans, children, order, at = [(0, len(rows))], [], np.lexsort((ids,)), 0
        while at < len(spans):
            a, b = spans[at]
            if b - a > LEAF:
                mine = order[a:b]
                along, cut = self.split(rows[mine])
                # Equal vectors keep the order of their ids, so that ties are told apart by whole nodes.
                order[a:b] = mine[np.argsort(along, kind="stable")]
                children.append((len(spans), len(spans) + 1))
                spans += [(a, a + cut), (a + cut, b)]
            else:
                children.append((-1, -1))
            at += 1
        self.rows, self.ids, self.labels = rows[order], ids[order], labels[order]
        self.spans, self.children = np.array(spans), np.array(children)
        own = [slice(a, b) for a, b in spans]
        self.centres = np.stack([self.rows[s].mean(0) for s in own]).reshape(len(spans), rows.shape[1])
        self.radii = np.array([np.sqrt(((self.rows[s] - c) ** 2).sum(1).max()) for s, c in zip(own, self.centres, strict=True)])
        self.least_id = np.array([self.ids[s].min() for s in own])
        #: The one label of a node's rows, or -1.
        self.label = np.array([self.labels[s][0] if (self.labels[s] == self.labels[s][0]).all() else -1 for s in own])

    @staticmethod
    def split(rows: np.ndarray) -> tuple[np.ndarray, int]:
        """Places along the line through two far rows, and how many lie nearer the first; half if that leaves a side with hardly a row."""
        if not rows.shape[1]:
            return np.zeros(len(rows)), len(rows) // 2
        far = lambda point: ((rows - point) ** 2).sum(1).argmax()
        first = rows[far(rows.mean(0))]
        second = rows[far(first)]
        along = rows @ (second - first)
        cut = int((along < (first + second) @ (second - first) / 2).sum())
        return along, cut if len(rows) // 16 < cut < len(rows) - len(rows) // 16 else len(rows) // 2

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and node, what no inner product with the node's rows is below or above."""
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows bounds nothing, and no comparison with it prunes
            middle = anchors @ self.centres.T
            length = np.linalg.norm(anchors, axis=1)[:, None]
            wide = length * self.radii * (1 + 1e-9)
            slack = 1e-9 * (1 + np.abs(middle) + length * (self.radii + np.linalg.norm(self.centres, axis=1)))
            return middle - wide - slack, middle + wide + slack


class Best:
    """The ``k`` best rows so far of each question: by score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), FAR)

    def beaten(self, asks: np.ndarray, upper: np.ndarray, least_id: np.ndarray | int) -> np.ndarray:
        """Which nodes are strictly beneath the current k-th row."""
        kth = self.scores[asks, -1]
        # A bound that rounds up to the k-th score still counts, so nothing that ties is lost.
        return (upper < kth) | ((np.floor(upper) <= kth) & (least_id > self.ids[asks, -1]))

    def offer(self, asks: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (``NONE``: not one) by question."""
        kth, last = self.scores[asks, -1:], self.ids[asks, -1:]
        better = (scores > kth) | ((scores == kth) & (scores > NONE) & (ids < last))
        some = better.any(1)
        if not some.any():
            return
        asks = asks[some]
        all_scores = np.concatenate([self.scores[asks], np.where(better[some], scores[some], NONE)], axis=1)
        all_ids = np.concatenate([self.ids[asks], np.where(better[some], np.broadcast_to(ids, better[some].shape), FAR)], axis=1)
        order = np.lexsort((all_ids, -all_scores.astype(np.float64)))
        exact = np.abs(all_scores[all_scores > NONE]).max(initial=0) >= EXACT
        if exact:  # scores that doubles cannot tell apart
            order = np.array([sorted(range(len(s)), key=lambda j: (-int(s[j]), i[j])) for s, i in zip(all_scores, all_ids, strict=True)])
        order = order[:, : self.scores.shape[1]]
        self.scores[asks] = np.take_along_axis(all_scores, order, 1)
        self.ids[asks] = np.take_along_axis(all_ids, order, 1)


def search(tree: Tree, anchors: np.ndarray, anchor_ids: np.ndarray, codes: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Best:
    """The ``k`` best rows of each question: of its anchor's label (``same``) or of others, with a score from ``low`` to ``high``.

    A question first walks down to its most promising leaf, which gives it a k-th row. Then all
    questions go down level by level, without nodes whose bounds lie outside the
    window or strictly beneath that row, and each leaf that is left meets
    its questions at once, those that it can still improve.
    """
    lower, upper = tree.bounds(anchors)
    least, best = tree.least_id, Best(len(owner), k)

    def fits(asks: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        own, u, v = owner[asks], upper[owner[asks], nodes], lower[owner[asks], nodes]
        pure = tree.label[nodes]
        wrong = (pure >= 0) & ((pure != codes[own]) if same else (pure == codes[own]))
        top = np.minimum(u, high[asks].astype(np.float64))
        return ~(wrong | (u < low[asks]) | (v > high[asks]) | best.beaten(asks, top, least[nodes]))

    def visit(leaf: int, asks: np.ndarray) -> None:
        a, b = tree.spans[leaf]
        own, where = np.unique(owner[asks], return_inverse=True)
        scores = products(anchors[own], tree.rows[a:b])
        label, ids = tree.labels[a:b], tree.ids[a:b]
        right = ((label == codes[own][:, None]) == same) & (ids != anchor_ids[own][:, None])
        scores = np.where(right, scores, NONE)[where]
        scores[(scores < low[asks, None]) | (scores > high[asks, None])] = NONE
        best.offer(asks, scores, ids)

    def in_leaves(asks: np.ndarray, leaves: np.ndarray) -> None:
        order = np.argsort(leaves, kind="stable")
        asks, leaves = asks[order], leaves[order]
        groups = np.split(np.arange(len(asks)), np.flatnonzero(np.diff(leaves)) + 1) if len(asks) else []
        for group in sorted(groups, key=len, reverse=True):
            mine, leaf = asks[group], leaves[group[0]]
            mine = mine[fits(mine, np.full(len(mine), leaf))]
            if len(mine):
                visit(leaf, mine)

    asks = np.arange(len(owner))
    nodes = np.zeros(len(owner), np.int64)
    going = fits(asks, nodes)
    while True:
        inner = going & (tree.children[nodes, 0] >= 0)
        if not inner.any():
            break
        at = np.flatnonzero(inner)
        kids = tree.children[nodes[at]]
        open_ = np.stack([fits(at, kids[:, j]) for j in (0, 1)], axis=1)
        bound = np.where(open_, np.minimum(upper[owner[at][:, None], kids], high[at, None]), -np.inf)
        nodes[at] = kids[np.arange(len(at)), bound.argmax(1)]
        going[at] = open_.any(1)
    in_leaves(asks[going], nodes[going])
    seen = np.where(going, nodes, -1)

    nodes = np.zeros(len(owner), np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(asks):
        keep = fits(asks, nodes)
        asks, nodes = asks[keep], nodes[keep]
        leaf = tree.children[nodes, 0] < 0
        new = leaf & (seen[asks] != nodes)
        leaves.append((asks[new], nodes[new]))
        asks, nodes = asks[~leaf], nodes[~leaf]
        asks, nodes = np.repeat(asks, 2), tree.children[nodes].ravel()
    in_leaves(np.concatenate([x for x, _ in leaves] or [asks]), np.concatenate([y for _, y in leaves] or [nodes]))
    return best


class Forest:
    """A partition's rows: one tree for each length of vectors."""

    def __init__(self, rows: pa.Table, scale: float):
        self.scale, self.trees = scale, {}
        self.names = pc.unique(rows["label"])
        codes = pc.index_in(rows["label"], value_set=self.names).to_numpy().astype(np.int64)
        ids, widths = rows["id"].to_numpy(), pc.list_value_length(rows["vector"]).to_numpy()
        for width in np.unique(widths):
            mine = np.flatnonzero(widths == width)
            self.trees[width] = Tree(self.whole(rows["vector"].take(mine), width), ids[mine], codes[mine])

    def whole(self, vectors: pa.ChunkedArray, width: int) -> np.ndarray:
        return np.floor(self.scale * matrix(vectors, int(width))) if width else np.zeros((len(vectors), 0))

    def answer(self, asked: pa.Table, windows: Callable[[pa.Table], tuple[np.ndarray, ...]], same: bool, k: int) -> Iterator[tuple[pa.Table, np.ndarray, Best]]:
        """(anchors, each question's anchor, its best rows), for anchors of one length at a time."""
        widths = pc.list_value_length(asked["vector"]).to_numpy()
        for width in np.unique(widths):
            tree, mine = self.trees.get(width), np.flatnonzero(widths == width)
            for at in range(0, len(mine) if tree else 0, ANCHORS):
                some = asked.take(mine[at : at + ANCHORS])
                codes = pc.fill_null(pc.index_in(some["label"], value_set=self.names), -1).to_numpy().astype(np.int64)
                owner, low, high = windows(some)
                yield some, owner, search(tree, self.whole(some["vector"], width), some["id"].to_numpy(), codes, owner, low, high, same, k)


def _meetings(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[Forest, pa.Table]]:
    """Each partition's trees with its anchors, batch by batch: batches come sorted, a partition's rows first."""
    part, held, forest = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = pa.Table.from_batches([batch.slice(a, b - a)])
            if parts[a] != part:
                part, held, forest = parts[a], [], None
            if not asks[a]:
                held.append(piece)
            elif held:
                forest, held = Forest(pa.concat_tables(held), scale), []
            if asks[a] and forest is not None:
                yield forest, piece


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each anchor's hard negatives by positive.

    Components become ``floor(scale * x)``, and scores are the whole inner products, exactly.
    An anchor's positives are its ``positives`` best other rows of its label; a positive's negatives are the
    ``negatives`` best rows of other labels with ``share[0] * positive_score <= share[1] * negative_score <= share[1] *
    positive_score``. Higher scores come first, ties go to the smaller key.

    Rows are dealt to partitions by hash, one copy each; every partition builds its trees, and the anchors, a stated
    query set, pass by all of them in batches. So a task holds ``PART_ROWS`` rows and one batch, whatever the
    number of anchors, and no partition depends on how often a label or vector occurs. Anchors meet the
    partitions twice, since a window is known only when all partitions have named the positives.

    Rows whose key, label or vector is null, or with a null or non-finite component, take no part.
    Rows that repeat as a whole count once; rows with the anchor's key are no candidates. Vectors of
    different lengths never meet; empty ones score 0 among themselves. A score that does not fit 64 bits is no
    candidate. Anchors without a positive, or positives without a negative, have no row; an empty table has none. Other columns are not looked at.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = vectors.withColumn("asks", F.coalesce(is_anchor, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"), "asks")
    rows = settled(named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).distinct(), "vectors")
    parts = max(MIN_PARTS, -(-rows.count() // PART_ROWS))
    uid = F.xxhash64("id", "label", "vector")
    dealt = rows.select(F.pmod(uid, parts).cast("int").alias("part"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("uid"), "id", "label", "vector")
    anchors = rows.filter("asks").select(uid.alias("uid"), "id", "label", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    none = F.lit(None).cast("array<struct<score:long,id:long>>").alias("positives")
    best = lambda by, score, second: F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), second))

    def met(asked: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        both = dealt.select("*", none).unionByName(asked.select(every, F.lit(True).alias("asks"), "*"))
        return both.repartition(parts, "part").sortWithinPartitions("part", "asks").mapInArrow(work, schema)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything = lambda some: (np.arange(len(some)), np.full(len(some), NONE + 1), np.full(len(some), FAR))
        for forest, asked in _meetings(batches, scale):
            for some, owner, best in forest.answer(asked, everything, True, positives):
                at, j = np.nonzero(best.scores > NONE)
                yield pa.RecordBatch.from_arrays([some["uid"].combine_chunks().take(pa.array(owner[at])), some["id"].combine_chunks().take(pa.array(owner[at])), pa.array(best.ids[at, j]), pa.array(best.scores[at, j])], names=["uid", "anchor_id", "id", "score"])

    found = met(anchors.select("*", none), near, "uid long, anchor_id long, id long, score long")
    found = found.withColumn("rank", best(["uid", "anchor_id"], "score", "id")).filter(F.col("rank") <= positives)
    lists = found.groupBy(F.col("uid").alias("uid_"), "anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "id")), asc=False).alias("positives"))
    asked = settled(anchors.join(lists, (F.col("uid") == F.col("uid_")) & (F.col("id") == F.col("anchor_id"))).select("uid", "id", "label", "vector", "positives"), "anchors")

    def windows(some: pa.Table) -> tuple[np.ndarray, ...]:
        lists = some["positives"].combine_chunks()
        owner = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
        high = lists.flatten().field("score").to_numpy()
        low = np.array([-(-share[0] * int(h) // share[1]) for h in high], np.int64).reshape(len(high))
        return owner, low, high

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forest, asked in _meetings(batches, scale):
            for some, owner, best in forest.answer(asked, windows, False, negatives):
                at, j = np.nonzero(best.scores > NONE)
                positive, own = some["positives"].combine_chunks().flatten().take(pa.array(at)), pa.array(owner[at])
                columns = [some["uid"].combine_chunks().take(own), some["id"].combine_chunks().take(own), positive.field("id"), positive.field("score"), pa.array(best.ids[at, j]), pa.array(best.scores[at, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    pairs = met(asked, hard, "uid long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    pairs = pairs.withColumn("rank", best(["uid", "anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id")).filter(F.col("rank") <= negatives)
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
