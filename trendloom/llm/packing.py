"""Arrays as table cells: blocks of a table exchange packed columns instead of single rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from trendloom.llm.textbytes import mix

_U = np.uint64


def press(column: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(column.tobytes())


def open_pressed(cells: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(c.as_py()), kind) for c in cells]


def press_ascending(keys: np.ndarray) -> bytes:
    """Ascending keys as steps, byte plane by byte plane: the upper planes are nearly all zero."""
    steps = np.diff(keys, prepend=_U(0))
    return press(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def open_ascending(cells: pa.ChunkedArray) -> list[np.ndarray]:
    planes = open_pressed(cells, np.uint8)
    return [np.cumsum(np.ascontiguousarray(p.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for p in planes]


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def split_keys(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of the keys dealt to each part, in place order."""
    part = (mix(keys) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]
