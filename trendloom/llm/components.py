"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.runtime import cut_lineage


def _attach_to_least(pairs: DataFrame) -> DataFrame:
    """(u, v, least): each pair with the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _attach_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u > v").distinct()
    small = _attach_to_least(large)
    return small.select(F.explode(F.array("v", "u")).alias("u"), F.col("least").alias("v")).where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id on an edge with the least id reachable from it.

    Alternates steps that hang all larger partners of an id on its least
    partner; the number of rounds is logarithmic.  Each round pre-aggregates
    per id and is written to the shared folder, so lost executors cost a
    re-read.  Loops and null ids are ignored.
    """
    current = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    state = None
    while True:
        current = cut_lineage(_round(current), "edges")
        new = tuple(current.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if new == state or not new[0]:
            break
        state = new
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
