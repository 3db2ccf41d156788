"""Session-level helpers: shared scratch space, lineage cuts, small checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``.  Only a
    local master may fall back to a folder of this machine.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="trendloom-")
        spark.conf.set(CHECKPOINT_SETTING, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage", group_rows: int | None = None, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Unlike a cached frame the result survives lost executors, and unlike an RDD
    checkpoint it is columnar and carries its true size, so the planner's own
    broadcast threshold is checked against real bytes.  Readers hold a row
    group's rows at once: ``group_rows`` bounds them where a row takes megabytes.
    ``compression`` is for large tables of keys and texts, which a stronger codec halves.
    """
    path = shared_dir(df.sparkSession, label)
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(condition: bool, message: str) -> None:
    """Plan-time parameter check."""
    if not condition:
        raise ValueError(message)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of shuffle partitions.

    For rows that grow later (texts into tokens): with a given number, adaptive
    execution does not merge the still small partitions into few tasks, and all
    later grouping by these keys needs no further shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
