"""What both vector searches need: clean rows, Arrow to numpy, and exact ranking of ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Not null, no null, NaN or infinite component; with ``nonzero`` not all zero."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & F.exists(vector, lambda x: x != 0) if nonzero else fine


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list column of equal lengths as rows x length."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]
