"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain column used inside a lambda is inlined by the optimizer and computed
    again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def counted(words: Column) -> Column:
    """Distinct entries of an array of texts with their number, ``array<struct<term, tf>>``: runs of the sorted array."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))

        def lengths(s: Column) -> Column:
            ends = F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(w)))
            return F.zip_with(s, ends, lambda a, b: F.struct(F.get(w, a).alias("term"), (b - a).cast("bigint").alias("tf")))

        return F.when(F.size(w) > 0, let(starts, lengths))

    return let(F.sort_array(words), runs)
