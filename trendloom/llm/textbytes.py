"""Texts as bytes: slices of Arrow tables, words and their hashes, in NumPy.

Words are runs of bytes other than ``\\x20 \\x09-\\x0D``; they never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letters, digits and everything beyond ASCII; what else stands between words is a break.
IS_BREAK = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no rows
        column = pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(table: pa.Table | pa.RecordBatch, text: str, size: int = 4 * PIECE) -> Iterator[tuple[pa.Table | pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about ``size`` bytes of text (or one longer text), each with its bytes and offsets."""
    data, at = column_bytes(table.column(text))
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield table.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words, runs of bytes not in ``breaks``; ``at`` holds the offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~breaks[data]
    first = np.ones(len(data) + 1, dtype=bool)  # a text begins here
    first[:-1] = False
    first[at] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE) + 1
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", np.uint64(pow(int(BASE), -1, 1 << 64)))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans given in ascending order; equal content gives equal hashes wherever it stands."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        begin, end = int(starts[i]), int(ends[i:j].max())
        up, down = _powers(end - begin + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(end - begin + 1, dtype=np.uint64)
            np.cumsum((data[begin:end].astype(np.uint64) + np.uint64(1)) * up[: end - begin], out=sums[1:])
            s, e = starts[i:j] - begin, ends[i:j] - begin
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def text_of(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the text each position lies in."""
    return np.searchsorted(at, starts, side="right") - 1


def per_text(numbers: np.ndarray, texts: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or sums of ``weights``) per text number."""
    return np.bincount(numbers, weights=weights, minlength=texts)[:texts]
