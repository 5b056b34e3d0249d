"""Hard negatives against all pairs: trees, ties, windows, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import hard_negatives


def plain(rows, anchor, positives=5, negatives=5):
    """rows: distinct (id, label, whole-numbered vector)."""
    out = []
    for a, label, v in [r for r in rows if anchor(r[0])]:
        scored = [(-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a and len(w) == len(v)]
        for p, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)[:negatives]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_tree_against_all_pairs(seed, monkeypatch):
    """Clusters, equal vectors and few distinct scores, with small leaves, so that bounds, ties and windows decide."""
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    rng = np.random.default_rng(seed)
    n = 300
    rows = np.floor(rng.normal(size=(n, 3)) * (1 + seed)) if seed % 2 else np.repeat(np.floor(rng.normal(size=(6, 5)) * 30), 50, axis=0) + (rng.random((n, 5)) < 0.1)
    ids, labels = rng.permutation(n), rng.integers(0, 3, n)
    tree = hard_negatives.Tree(rows, ids, labels)
    assert sorted(tree.ids) == list(range(n)) and len(tree.spans) > 20
    lower, upper = tree.bounds(rows[:40])
    for node, (a, b) in enumerate(tree.spans):
        s = rows[:40] @ tree.rows[a:b].T
        assert (s.min(1) >= lower[:, node]).all() and (s.max(1) <= upper[:, node]).all()
    owner = np.repeat(np.arange(40), 3)
    low = rng.integers(-50, 40, 120)
    high = low + rng.integers(-2, 60, 120)
    for same in (True, False):
        best = hard_negatives.search(tree, rows[:40], ids[:40], labels[:40], owner, low, high, same, 5)
        for q, o in enumerate(owner):
            s = (rows @ rows[o]).astype(int)
            want = sorted((-s[j], ids[j]) for j in range(n) if j != o and (labels[j] == labels[o]) == same and low[q] <= s[j] <= high[q])[:5]
            got = [(-x, i) for x, i in zip(best.scores[q], best.ids[q], strict=True) if x > hard_negatives.NONE]
            assert got == want


def test_nodes_are_pruned(monkeypatch):
    """On clustered rows most leaves are never looked at."""
    rng = np.random.default_rng(1)
    rows = np.floor(np.repeat(rng.normal(size=(40, 16)) * 200, 100, axis=0) + rng.normal(size=(4000, 16)) * 3)
    tree = hard_negatives.Tree(rows, np.arange(4000), np.zeros(4000, np.int64))
    looked = []
    monkeypatch.setattr(hard_negatives, "products", lambda a, b, own=hard_negatives.products: looked.append(len(a) * len(b)) or own(a, b))
    n = 50
    hard_negatives.search(tree, rows[:n], np.arange(n), np.zeros(n, np.int64), np.arange(n), np.full(n, hard_negatives.NONE + 1), np.full(n, hard_negatives.FAR), True, 5)
    assert sum(looked) < 0.3 * n * 4000


def test_odd_rows(spark, monkeypatch):
    """Nulls, other lengths, zero and empty vectors, repeated rows, equal vectors, a hot label, huge numbers, other columns."""
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [round(float(x), 3) for x in rng.normal(size=4)], int(rng.integers(0, 3)) if i % 3 else 1) for i in range(200)]
    rows += [(200 + i, [0.5, 0.25, 0.0, -1.0], i % 2) for i in range(60)] + [(300, [0.0] * 4, 1), (310, [], 1), (311, [], 1), (312, [], 2), (320, [1.0, 2.0], 1), (321, [1.0, 2.0], 1), (322, [1.0, 1.9], 2)]
    rows += [(400, [3e12, 1.0, 2.0, 1.0], 1), (401, [2.9e12, 1.0, 2.0, 2.0], 1), (402, [2.8e12, 1.0, 2.0, 2.0], 2), (500, [1e200] * 4, 1)]
    bad = [(None, [1.0] * 4, 1), (510, None, 1), (520, [1.0, None, 1.0, 1.0], 1), (530, [float("nan")] * 4, 1), (540, [float("inf")] * 4, 1), (550, [1.0] * 4, None)]
    schema = "vec_id long, embedding array<double>, label int, asks int, part string, uid boolean, positives long"
    frame = spark.createDataFrame([(*r, 1, "x", None, 2) for r in rows + bad + rows[:30] + rows[200:220]], schema).repartition(5)
    whole = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, v, y in rows]
    fit = lambda a, b: abs(sum(x * y for x, y in zip(a[2], b[2], strict=False))) < 1 << 63
    want = []
    for a in [w for w in whole if w[0] % 10 == 0]:  # scores beyond 64 bits are no candidates
        want += plain([a, *[w for w in whole if w is not a and fit(a, w)]], lambda i, a=a: i == a[0])
    got = sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).collect())
    assert got == sorted(want) and {400, 310, 320} <= {r[0] for r in got}
    assert hard_negatives.mine(frame.limit(0), F.lit(True)).count() == 0
