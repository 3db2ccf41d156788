"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.runtime import require


def _draw(key: Column, shard: int, seed: int) -> Column:
    """A uniform number in (0, 1) that only the key, the shard and the seed decide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 to ``len(weights) - 1``) with the highest weighted score of ``key``.

    A score is ``-weight / ln(u)`` with ``u`` drawn from the hash of key and
    shard, so a shard receives keys in proportion to its weight.  One more
    shard takes keys only into itself; one less gives up only its own; a
    changed weight moves keys only into or out of that shard.  A null key is a
    key like any other.  Equal scores go to the lower shard.
    """
    require(len(weights) > 0 and all(w > 0 for w in weights), "weights must be positive")
    scores = [F.struct((-F.lit(float(w)) / F.log(_draw(key, i, seed))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["shard"]


def shard_records(
    df: DataFrame, key: str, weights: Sequence[float], *, grown_weights: Sequence[float] | None = None, seed: int = 0, shard: str = "shard", slot: str = "slot", grown: str = "grown_shard", order: Sequence[str] = (),
) -> DataFrame:
    """All rows of ``df`` with their shard and a gapless position (from 0) in it.

    ``grown_weights`` adds the shard each row would have with those shards.
    Positions follow buckets of the key's hash, then ``key`` and ``order``: each
    bucket is numbered by itself and starts where the counts of the earlier
    buckets of its shard end, so no task sees a whole shard.  The number of
    buckets follows ``spark.sql.shuffle.partitions``; rerunning with the same
    setting gives the same positions.  Rows with equal key and order values
    share a bucket and take their positions in any order.  An empty table stays
    empty.  Existing columns named as a result are replaced.
    """
    spark = df.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = "__bucket"
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), *[F.col(c) for c in order]), F.lit(buckets))
    placed = df.drop(slot).withColumn(shard, rendezvous_shard(F.col(key), weights, seed).cast("int")).withColumn(bucket, spread)
    if grown_weights is not None:
        placed = placed.withColumn(grown, rendezvous_shard(F.col(key), grown_weights, seed).cast("int"))
    counts = placed.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, bucket).orderBy(key, *order)
    numbered = placed.withColumn("__row", F.row_number().over(within)).join(starts, [shard, bucket])
    return numbered.withColumn(slot, F.col("__start") + F.col("__row") - 1).drop(bucket, "__row", "__start")
