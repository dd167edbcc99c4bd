"""Vectors in columns: which are usable, their compact form, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column, width: int) -> Column:
    """True for a vector that is not null, has ``width`` finite values and is not all zero; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column as float32 rows, and the places they stand at."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, width), np.float32), np.empty(0, np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    good = lengths == width
    if column.null_count:
        good &= np.asarray(column.is_valid())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    starts = column.offsets.to_numpy()[:-1][good]
    at = np.flatnonzero(good)
    if len(at) and starts[-1] - starts[0] == width * (len(at) - 1):
        rows = values[starts[0] : starts[0] + width * len(at)].reshape(-1, width)
    else:
        rows = values[starts[:, None] + np.arange(width)] if len(at) else np.empty((0, width), np.float32)
    with np.errstate(invalid="ignore", over="ignore"):
        kept = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
    return (rows, at) if kept.all() else (rows[kept], at[kept])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in float32; the length is taken in double, after scaling, so that nothing over- or underflows."""
    if not len(rows):
        return rows.astype(np.float32)
    top = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / top
    length = np.sqrt(np.einsum("ij,ij->i", scaled, scaled, dtype=np.float64))
    return (scaled / length[:, None]).astype(np.float32)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as bytes, without loss: in half precision where every value survives it, else in single."""
    with np.errstate(over="ignore"):
        half = rows.astype(np.float16)
    exact = (half.astype(np.float32) == rows).all(axis=1)
    return [half[i].tobytes() if exact[i] else rows[i].tobytes() for i in range(len(rows))]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The float32 rows of a column of packed vectors."""
    cells = column.to_pylist()
    out = np.empty((len(cells), width), np.float32)
    for i, cell in enumerate(cells):
        out[i] = np.frombuffer(cell, np.float16 if len(cell) == 2 * width else np.float32)
    return out
