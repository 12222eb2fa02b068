"""Small numpy helpers that run on whole Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Similarities are compared to this many digits, about what double sums of products agree on whatever
# their order; only (near enough) equal vectors tie, and ties are broken by path and chunk.
DIGITS = 12


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix with rows of length one.

    Rows without a direction (all zero, or not finite) become zero; cosine is undefined for them.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0))
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    usable = np.isfinite(norms) & (norms > 0)
    return np.divide(matrix, norms, out=np.zeros(matrix.shape), where=usable)


def cosine_to(vector: Sequence[float]) -> Callable[[Column], Column]:
    """Arrow UDF: cosine of each vector of a column with one given vector, NULL where undefined."""
    target = np.asarray(vector, dtype=np.float64)
    target = target / np.linalg.norm(target)

    @F.arrow_udf(T.DoubleType())
    def cosine(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.float64())
        units = unit_rows(vectors)
        return pa.array(np.round(units @ target, DIGITS), mask=~units.any(axis=1))

    return cosine


def nearest_pivot(pivots: np.ndarray) -> Callable[[Column], Column]:
    """Arrow UDF: (cell, angle) of the nearest of the given unit vectors."""

    @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def nearest(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.float64())], ["cell", "angle"])
        units = unit_rows(vectors)
        cosines = units @ pivots.T
        cell = cosines.argmax(axis=1).astype(np.int32)
        angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1.0, 1.0))
        angle[~units.any(axis=1)] = 0.0  # never compared, so they must not widen a cell
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], ["cell", "angle"])

    return nearest
