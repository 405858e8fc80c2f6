"""Arrow <-> NumPy moves shared by the batch kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Images that a kernel holds as Python objects at a time, whatever the size of a batch.
HELD_IMAGES = 128


def pieces(batches: Iterator[pa.RecordBatch], rows: int = HELD_IMAGES) -> Iterator[pa.RecordBatch]:
    """The batches in slices; they share the batches' memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """List column whose rows all have `width` numbers, as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.Array:
    """2-D array as a list column."""
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), pa.float64())
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def byte_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary column whose rows all have `width` bytes, as a 2-D array."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(column), width)


def let(value: Column, body) -> Column:
    """Bind `value` to a name inside an expression, so it is computed once.

    A lambda body is computed for each element; a sub-expression in it that does
    not depend on the element is computed each time too.
    """
    return F.get(F.transform(F.array(value), body), 0)


def dct_basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II basis, one row per frequency."""
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2.0 / n)
    basis[0] /= np.sqrt(2.0)
    return basis
