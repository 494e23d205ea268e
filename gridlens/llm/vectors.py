"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_DOUBLE, EXACT_LONG = 2**53, 2**63


def doubles(vector: Column) -> Column:
    """A vector as doubles; null if it is null or holds a null or a component that is no finite number."""
    v = vector.cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, v)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors (arrays without nulls) as rows of a matrix.

    Vectors of another length than `width` have no place in it, which is an error that names both.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors of {width} and of {int(lengths[lengths != width][0])} components in one table")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as whole numbers; an error beyond 64 bits."""
    y = np.floor(x * float(scale))
    if y.size and not np.abs(y).max() < EXACT_LONG:
        raise OverflowError("a component times the scale does not fit 64 bits")
    return y.astype(np.int64)
