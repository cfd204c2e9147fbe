"""Vector functions: as Column expressions, and in Arrow batches for scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cosine``; 1 for empty or unequally long vectors and where a norm is zero or not a number."""
    scale = norm(a) * norm(b)
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0) & ~F.isnan(scale)
    return F.when(fine, 1 - dot(a, b) / scale).otherwise(F.lit(1.0))


def score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def l2_normalize(v: Column) -> Column:
    """A vector of length zero stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


@F.pandas_udf(T.BinaryType())
def pack(v):
    """Raw little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(b):
    return b.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4"))


def batch_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array column: places of non-empty vectors, those of them of ``dim`` elements without nulls, and their matrix in double."""
    lengths = np.diff(np.asarray(column.offsets))
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    present = np.flatnonzero(lengths > 0)
    fit = np.flatnonzero(lengths == dim)
    if not len(fit):
        return present, fit, np.empty((0, dim))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.asarray(column.offsets)[fit]
    return present, fit, flat[at[:, None] + np.arange(dim)]


def batch_distances(column: pa.Array, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the non-empty vectors of a column, and their cosine distances (a column a query).

    Sums run over the elements in their order, as in SQL engines: a matrix product rounds a row by its place in the batch, so that copies
    of a vector would be at distances that differ in the last bits, or below 0, and their order would not be that of their ids.
    """
    present, fit, m = batch_matrix(column, queries.shape[1])
    d = np.ones((len(column), len(queries)))
    if len(fit):
        with np.errstate(all="ignore"):
            dots, own, norms = np.zeros((len(fit), len(queries))), np.zeros(len(fit)), np.zeros(len(queries))
            for x, y in zip(np.ascontiguousarray(m.T), queries.T, strict=True):
                dots += np.multiply.outer(x, y)
                own += x * x
                norms += y * y
            product = own[:, None] * norms
            scale = np.sqrt(product)
            odd = (product < np.finfo(float).tiny) | ~np.isfinite(product)  # too small or large for a product, but perhaps not for one of roots
            if odd.any():
                scale = np.where(odd, np.sqrt(own)[:, None] * np.sqrt(norms), scale)
            got = 1 - np.clip(dots / scale, -1, 1)
            d[fit] = np.where((scale > 0) & np.isfinite(scale) & np.isfinite(got), got, 1.0)
    return present, d[present]
