"""Reading vector columns: which rows can be compared, and their numbers as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def comparable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles; rows that are shorter than ``width`` end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres at most, by Lloyd's rounds from random rows; empty ones stay where they were."""
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, rows[:, j], len(centres)) for j in range(rows.shape[1])], 1)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its squared distance to all of them."""
    d = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)
    return d.argmin(1), np.maximum(d, 0)
