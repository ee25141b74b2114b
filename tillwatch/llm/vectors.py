"""Vectors as integers, for the operators that compute on them exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def finite_rows(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of an Arrow list column without NULL or non-finite entries: (rows, matrix of doubles) for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array(column.value_lengths().fill_null(-1).to_pylist(), dtype=np.int64)
    flat = column.flatten()  # leaves out the entries of NULL lists
    missing = np.asarray(flat.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = missing | ~np.isfinite(values)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    before = np.concatenate([[0], np.cumsum(bad)])
    good = (sizes >= 0) & (before[starts[1:]] == before[starts[:-1]])
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == size))
        at = starts[rows][:, None] + np.arange(size)
        yield rows, values[at].reshape(len(rows), int(size))


def scaled(matrix: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, held within plus or minus `limit`."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix * scale), -limit, limit).astype(np.int64)


def is_finite(column: str):
    """True where a list column is neither NULL nor holds a NULL or non-finite entry."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.col(column).isNotNull() & ~F.coalesce(F.exists(column, entry), F.lit(False))
