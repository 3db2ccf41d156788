"""Whitening of embeddings: exact integer statistics, components by spectral divide and conquer, one pass that projects every row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.spectral import EPS, eigenvectors
from trendloom.runtime import require

SCALE, OFFSET = 64, 1_000_000
#: Entries of this size or more have no exact whole number of 1/64 and count as non-finite.
TOO_LARGE = float(1 << 46)
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class WhiteningModel:
    """Count, sums and components of the vectors it was fitted on; ``values`` falls, ``basis`` has one column per component."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]


def is_vector(vector: str | Column) -> Column:
    """Whether a vector has entries, and all of them are finite numbers."""
    column = F.col(f"`{vector}`") if isinstance(vector, str) else vector
    small = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < TOO_LARGE))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & small, F.lit(False))


def _whole(column: pa.ChunkedArray | pa.Array, dim: int, *, shift: np.ndarray | None = None) -> np.ndarray:
    """Rows of whole numbers ``floor(64 c) + 1000000``, less ``shift``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim) + OFFSET
    return x if shift is None else x - shift


def _pieces(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of at most about 16 MB of numbers, each with its vectors."""
    rows = max(1, (1 << 21) // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(part.schema.get_field_index("__vector"))


def _entry_sums(rows: DataFrame, width: int) -> dict[int, int | float]:
    """Sums of the cells of a (row, cells) table by place; pre-aggregated before the shuffle, ``width`` squared rows at most come back."""
    cells = rows.select("row", F.posexplode("cells").alias("place", "cell"))
    return {r[0] * width + r[1]: r[2] for r in cells.groupBy("row", "place").agg(F.sum("cell")).toLocalIterator()}


def _covariance(vectors: DataFrame, n: int, sums: np.ndarray, bound: int) -> np.ndarray:
    """Covariance with divisor n.  ``sums`` are exact; ``bound`` holds the distance of any entry from its rounded mean."""
    dim = len(sums)
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([int(s) - n * int(m) for s, m in zip(sums, middle, strict=True)], dtype=object)
    exact = bound * bound * n <= _LONG
    rows_at_once = max(1, min(1 << 16, _EXACT // max(1, bound * bound)))
    mean_rest = np.array([int(r) / n for r in rest])

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=np.int64 if exact else float)
        for _, column in _pieces(batches, dim):
            y = _whole(column, dim, shift=middle)
            if not exact:  # numbers too large for exact products: centred before multiplying, in double precision
                z = y - mean_rest
                total += z.T @ z
                continue
            for at in range(0, len(y), rows_at_once):
                part = y[at : at + rows_at_once].astype(float)
                total += (part.T @ part).astype(np.int64)  # sums below 2^53, exact in double precision
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64() if exact else pa.float64()))], names=["row", "cells"])

    cells = _entry_sums(vectors.mapInArrow(products, f"row int, cells array<{'bigint' if exact else 'double'}>"), dim)
    covariance = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(dim):
            entry = cells.get(i * dim + j, 0)
            # The mean that is left after the shift is taken off in whole numbers, with one rounding at the end.
            covariance[i, j] = (n * int(entry) - rest[i] * rest[j]) / (n * n) if exact else entry / n
    return covariance


def vector_rows(table: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(the rows with a whole vector, its length).

    Where vectors differ in length the most frequent length (of equally
    frequent ones the greatest) counts and other rows are left out; 0
    stands for a table without any vector.
    """
    sound = table.where(is_vector(vector_col))
    common = sound.groupBy(F.size(F.col(f"`{vector_col}`")).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return sound, 0
    return sound.where(F.size(F.col(f"`{vector_col}`")) == common["dim"]), common["dim"]


def fit_whitening(table: DataFrame, vector_col: str = "embedding", *, components: int = 32, verify: bool = True) -> WhiteningModel:
    """Means, covariance and components of all vectors of a table.

    Sums and products of the whole numbers are exact, so a lost executor or
    another order of tasks changes nothing.  A task hands on one row per dimension; the
    driver holds matrices of the square of the dimension, never rows.
    Components whose eigenvalue is zero up to rounding have no whitened value and are left out, so the
    result may have fewer than ``components``: none for an empty table, one row or equal rows.
    ``verify`` reads the vectors once more for ``identity_error``, the largest difference between the covariance
    of the whitened vectors and the identity.
    """
    require(components > 0, "components must be positive")
    rows, dim = vector_rows(table, vector_col)
    if not dim:
        return WhiteningModel(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    vectors = rows.select(F.col(f"`{vector_col}`").alias("__vector"))

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, low, high = 0, np.zeros(dim, dtype=object), None, None
        for _, column in _pieces(batches, dim):
            x = _whole(column, dim, shift=np.int64(OFFSET))
            count += len(x)
            if np.abs(x).max() <= _LONG // (2 * len(x)):
                sums = sums + x.sum(axis=0).astype(object)
            else:
                sums = sums + x.astype(object).sum(axis=0)
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if count:
            # Sums may pass 64 bits: they travel in two parts.
            parts = [[int(s) >> 32 for s in sums], [int(s) & 0xFFFFFFFF for s in sums]]
            columns = [pa.array(range(dim), pa.int32()), *(pa.array(p, pa.int64()) for p in parts), pa.array(low), pa.array(high), pa.array([count] * dim, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "upper", "lower", "low", "high", "n"])

    told = vectors.mapInArrow(totals, "dim int, upper bigint, lower bigint, low bigint, high bigint, n bigint")
    by_dim = told.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("upper", "lower", "n")], F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    n = by_dim[0]["n"]
    sums = np.array([(r["upper"] << 32) + r["lower"] + OFFSET * n for r in by_dim], dtype=object)
    bound = max(max(r["high"] + OFFSET - int(s) // n, int(s) // n - r["low"] - OFFSET) + 1 for r, s in zip(by_dim, sums, strict=True))
    covariance = _covariance(vectors, n, sums, bound)
    values, basis = eigenvectors(covariance)
    kept = int((values[:components] > dim * EPS * max(float(values[0]), 0.0)).sum())
    model = WhiteningModel(n, sums, values[:kept], basis[:, :kept], float(np.trace(covariance)))
    if not verify or not kept:
        return model

    def squares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, kept))
        for _, column in _pieces(batches, dim):
            w = _project(column, model)[1]
            total += w.T @ w  # deviations from the mean add up to zero exactly, so these are centred
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(kept), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "cells"])

    cells = _entry_sums(vectors.mapInArrow(squares, "row int, cells array<double>"), kept)
    whitened = np.array([cells[i] / n for i in range(kept * kept)]).reshape(kept, kept)
    return WhiteningModel(n, sums, model.values, model.basis, model.trace, float(np.abs(whitened - np.eye(kept)).max()))


def _project(column: pa.ChunkedArray | pa.Array, model: WhiteningModel) -> tuple[list[int | None], np.ndarray]:
    """(exact sums of squares of n x - S, null beyond 64 bits; whitened rows)."""
    n, dim = model.n, len(model.sums)
    middle = np.array([int(s) // n for s in model.sums], dtype=np.int64)
    rest = [int(s) - n * int(m) for s, m in zip(model.sums, middle, strict=True)]
    y = _whole(column, dim, shift=middle)
    largest = n * (int(np.abs(y).max()) + 1) if len(y) else 0
    if dim * largest * largest <= _LONG:
        t = n * y - np.array(rest, dtype=np.int64)
        squares: list[int | None] = (t * t).sum(axis=1).tolist()
    else:
        t = y.astype(object) * n - np.array(rest, dtype=object)
        squares = [s if s <= _LONG else None for s in (t * t).sum(axis=1).tolist()]
    centred = t.astype(float) / n
    return squares, centred @ (model.basis / np.sqrt(model.values))


def whiten(table: DataFrame, model: WhiteningModel, vector_col: str = "embedding") -> DataFrame:
    """The rows of ``table`` with a vector of the model's length, with ``deviation`` and ``whitened``.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2 (null
    where it passes 64 bits), ``whitened`` the centred vector on each component over the root of its
    eigenvalue.  The model, bounded by the dimension, travels with the task.  Rows without a whole vector are
    left out; ties, repeated rows and null ids stand for themselves.  Existing columns of these names are replaced.
    """
    dim, kept = len(model.sums), table.drop(*[c for c in ("deviation", "whitened") if c != vector_col])
    sound = kept.where(is_vector(vector_col) & (F.size(F.col(f"`{vector_col}`")) == dim))
    schema = kept.withColumn("deviation", F.lit(None).cast("bigint")).withColumn("whitened", F.array().cast("array<double>")).schema
    source = sound.withColumn("__vector", F.col(f"`{vector_col}`"))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in _pieces(batches, dim):
            squares, rows = _project(column, model)
            place = part.schema.get_field_index("__vector")
            columns = [part.column(i) for i in range(part.num_columns) if i != place]
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(squares, pa.int64()), cells], names=[*(c for i, c in enumerate(part.schema.names) if i != place), "deviation", "whitened"])

    if not dim:
        return kept.withColumn("deviation", F.lit(None).cast("bigint")).withColumn("whitened", F.array().cast("array<double>")).where(F.lit(False))
    return source.mapInArrow(project, schema)
