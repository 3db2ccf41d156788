"""Exact de-duplication by Grace hashing: partition, spill, compare complete content."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

TABLE_BYTES = 24 << 20
FAN_OUT_BITS = 4


def content_schema(ids: pa.DataType) -> pa.Schema:
    return pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep", ids), ("n", pa.int64())])


CONTENT = content_schema(pa.int64())


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete content is equal."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.keep: list[int | str | None] = []
        self.n: list[int] = []
        self.bytes = 0

    def _probe(self, digest: bytes, content: bytes) -> tuple[int, int]:
        mask = len(self.slots) - 1
        slot = int.from_bytes(digest[-8:], "little") & mask
        while (at := self.slots[slot]) >= 0:
            if self.digests[at] == digest and self.contents[at] == content:
                return slot, at
            slot = (slot + 1) & mask
        return slot, -1

    def add(self, digest: bytes, content: bytes, keep: int | str | None, n: int) -> None:
        slot, at = self._probe(digest, content)
        if at >= 0:
            self.n[at] += n
            if keep is not None and (self.keep[at] is None or keep > self.keep[at]):
                self.keep[at] = keep
            return
        self.slots[slot] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.keep.append(keep)
        self.n.append(n)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            for at, (d, c) in enumerate(zip(self.digests, self.contents, strict=True)):
                mask, slot = len(self.slots) - 1, int.from_bytes(d[-8:], "little")
                while self.slots[slot & mask] >= 0:
                    slot += 1
                self.slots[slot & mask] = at

    def batches(self, schema: pa.Schema, rows_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        columns = {"digest": self.digests, "content": self.contents, "keep": self.keep, "n": self.n}
        step = max(1, int(len(self.n) * rows_bytes / max(1, self.bytes))) if "content" in schema.names else 50_000
        for i in range(0, len(self.n), step):
            yield pa.record_batch([pa.array(columns[f.name][i : i + step], f.type) for f in schema], schema=schema)


def _combine(batches: Iterable[pa.RecordBatch], stored: pa.Schema = CONTENT) -> Iterator[pa.RecordBatch]:
    """Merges equal contents of one input split before anything is shuffled."""
    table = ContentTable()
    for batch in batches:
        for content, keep in zip(batch.column(0), batch.column(1), strict=True):
            raw = content.as_py()
            table.add(hashlib.sha256(raw).digest(), raw, keep.as_py(), 1)
            if table.bytes > TABLE_BYTES:
                yield from table.batches(stored)
                table = ContentTable()
    yield from table.batches(stored)


def _bucket(digest: bytes, level: int) -> int:
    bit = level * FAN_OUT_BITS
    return (int.from_bytes(digest[:8], "big") >> (60 - bit)) & ((1 << FAN_OUT_BITS) - 1)


def _grace(records: Iterable[pa.RecordBatch], level: int, schema: pa.Schema, stored: pa.Schema = CONTENT) -> Iterator[pa.RecordBatch]:
    """Distinct contents of ``records``: in one table if they fit, else bucket by bucket from spill files.

    The first table stays open while further records come; once it is full,
    it and all later records go to spill files by the next bits of the
    digest, and each file is handled the same way.  Repeated contents never
    fill a table, so only distinct contents are split, and those differ in
    their digests.
    """
    table, files, writers = ContentTable(), [], []
    with tempfile.TemporaryDirectory() as folder:
        for batch in records:
            for row in zip(*(batch.column(c).to_pylist() for c in CONTENT.names), strict=True):
                table.add(*row)
            if table.bytes > TABLE_BYTES and level * FAN_OUT_BITS < 60:
                if not files:
                    files = [f"{folder}/{i}" for i in range(1 << FAN_OUT_BITS)]
                    writers = [pa.ipc.new_stream(f, stored, options=pa.ipc.IpcWriteOptions(compression="zstd")) for f in files]
                _spill(table, level, writers, stored)
                table = ContentTable()
        if not files:
            yield from table.batches(schema)
            return
        _spill(table, level, writers, stored)
        del table
        for w in writers:
            w.close()
        for f in files:
            with pa.OSFile(f) as source, pa.ipc.open_stream(source) as reader:
                yield from _grace(reader, level + 1, schema, stored)


def _spill(table: ContentTable, level: int, writers: list, stored: pa.Schema) -> None:
    for batch in table.batches(stored):
        where = np.array([_bucket(d.as_py(), level) for d in batch.column(0)])
        for b in np.unique(where):
            writers[b].write_batch(batch.filter(pa.array(where == b)))


def _resolve(batches: Iterable[pa.RecordBatch], stored: pa.Schema = CONTENT) -> Iterator[pa.RecordBatch]:
    return _grace(batches, 0, pa.schema([stored.field("digest"), stored.field("keep"), stored.field("n")]), stored)


def id_type(df: DataFrame, id_col: str) -> str:
    """``long`` for whole numbers, ``string`` for all other ids."""
    return "long" if isinstance(df.select(id_col).schema[0].dataType, IntegralType) else "string"


def exact_duplicates(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """One row per distinct content: ``digest`` (SHA-256 of its UTF-8), ``keep`` (largest id), ``n``.

    Input splits merge their own copies first (a table of bounded size), so a
    content that a third of all rows share is shuffled once or a few times per
    split.  The shuffle deals contents by digest; each partition then works as
    Grace hashing does, with spill files in the task's temporary folder that go
    when the task ends.  Null content counts as empty.  Whole-number ids
    compare as numbers, all others as text by code point.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = id_type(df, id_col)
    stored = content_schema(pa.int64() if ids == "long" else pa.string())
    combine, resolve = partial(_combine, stored=stored), partial(_resolve, stored=stored)
    rows = df.select(F.coalesce(content, F.lit("")).cast("binary").alias("content"), F.col(id_col).cast(ids).alias("keep"))
    merged = rows.mapInArrow(combine, f"digest binary, content binary, keep {ids}, n long")
    return merged.repartition(n, "digest").mapInArrow(resolve, f"digest binary, keep {ids}, n long")


def mark_exact_duplicates(df: DataFrame, id_col: str, text_col: str, *, keep_col: str = "keep_id", size_col: str = "group_size", kept_col: str = "kept", digest_col: str = "text_sha256") -> DataFrame:
    """All rows of ``df`` with the id that stays of their text's group, the group's size, and whether they stay.

    Of equal texts the row with the largest id stays (ids that are no whole
    numbers compare as text, and ``keep_col`` is text then); null equals empty; rows
    repeated with the same id and text are all kept.  Rows without id never
    stay beside one that has an id.  An empty table gives an empty result.
    Columns of ``df`` named as a result are replaced; others pass through.
    """
    content = F.coalesce(F.col(text_col), F.lit(""))
    groups = exact_duplicates(df, id_col, F.col(text_col)).select(
        F.lower(F.hex("digest")).alias(digest_col), F.col("keep").alias(keep_col), F.col("n").alias(size_col))
    rows = df.drop(keep_col, size_col, kept_col, digest_col).withColumn(digest_col, F.sha2(content, 256))
    return rows.join(groups, digest_col).withColumn(kept_col, F.col(id_col).cast(id_type(df, id_col)).eqNullSafe(F.col(keep_col)))
