"""Vector distances, element types and quantization.

Distances are columns over arrays of doubles (the semantic baseline, no Python)
and numpy kernels for batches.  Lower is nearer.  Vectors of other lengths give
null; a zero vector is at cosine distance 0 from everything; NaN sorts last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the metrics.
METRICS = {"cosine": "cosine", "euclidean": "l2", "l2": "l2", "dot": "dot", "dotproduct": "dot"}
DTYPES = {"F32": "<f4", "F16": "<f2", "I8": "i1"}


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    metric = METRICS[metric]
    if metric == "l2":
        value = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    elif metric == "dot":
        value = F.lit(0.0) - dot(a, b)
    else:
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        value = F.when(norms == 0, F.lit(0.0)).otherwise(1.0 - dot(a, b) / norms)
    return F.when(F.size(a) == F.size(b), value)


def distances(queries: np.ndarray, data: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks of rows, by one product."""
    metric = METRICS[metric]
    inner = queries @ data.T
    if metric == "dot":
        return -inner
    if metric == "l2":
        return np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (data**2).sum(1)[None, :] - 2 * inner, 0))
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(data, axis=1)[None, :]
    return np.where(norms == 0, 0.0, 1 - inner / np.where(norms == 0, 1, norms))


def decode_elements(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(data, dtype=DTYPES[dtype]).astype(np.float32)


def encode_elements(values, dtype: str) -> bytes:
    return np.asarray(values).astype(DTYPES[dtype]).tobytes()


def scalar_quantized(vector: Column) -> Column:
    """Eight bits a value by the vector's own bounds: (v - min) * 255 / (max - min) - 128, cut toward zero; scale 1 if flat."""
    low, high = F.array_min(vector), F.array_max(vector)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    scaled = F.transform(vector, lambda v: (v - low) * F.lit(255.0) / span - F.lit(128.0))
    return F.transform(scaled, lambda v: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), v)).cast("int"))
