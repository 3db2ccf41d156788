"""Vector algebra on ``ARRAY<FLOAT|DOUBLE>`` columns, as Catalyst expressions.

Sums always run in double precision.  ``None`` and wrong-width vectors give
``NULL`` rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.arrays import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; ``NULL`` when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def unit(a: Column) -> Column:
    """The vector scaled to length one; ``NULL`` for the zero vector."""

    def scaled(v: Column, length: Column) -> Column:
        return F.when(length > 0, F.transform(v, lambda x: x / length))

    return let(as_double(a), lambda v: let(norm(v), lambda length: scaled(v, length)))


def sum_by(df: DataFrame, keys: list[str], vec: str, dim: int, out: str, *others: Column) -> DataFrame:
    """Element-wise vector sum per key.

    One ``sum`` per dimension keeps the work inside a hash aggregate with
    map-side combine: a key that holds a third of the rows shuffles one partial
    row per task, and no row is ever exploded into ``dim`` rows.
    """
    wide = df.where(F.size(vec) == dim)
    sums = [F.sum(F.col(vec)[i].cast("double")).alias(f"_d{i}") for i in range(dim)]
    grouped = wide.groupBy(*keys).agg(*sums, *others)
    packed = F.array(*[F.col(f"_d{i}") for i in range(dim)]).alias(out)
    kept = [c for c in grouped.columns if not c.startswith("_d")]
    return grouped.select(*kept, packed)


def mean_by(df: DataFrame, keys: list[str], vec: str, dim: int, out: str, *others: Column) -> DataFrame:
    """Element-wise mean per key, with the number of rows as ``document_count``."""
    summed = sum_by(df, keys, vec, dim, "_sum", F.count(F.lit(1)).alias("document_count"), *others)
    mean = F.transform("_sum", lambda x: x / F.col("document_count"))
    return summed.withColumn(out, mean).drop("_sum")
