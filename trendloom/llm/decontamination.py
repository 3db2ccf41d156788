"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_MATCH = 5
BLOCK_BYTES = 8 << 20
WORDS = re.compile(r"\w+")
KARP = np.uint64(0x9E3779B97F4A7C15)
RESULT = "item_id long, item_tokens int, matched_tokens int, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>"


def tokens(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin values of all windows of ``length`` ids."""
    out = np.zeros(max(0, len(ids) - length + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * KARP + ids[k : k + len(out)].astype(np.uint64)
    return out


def greedy_tiles(text: Sequence[int], pattern: Sequence[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (text start, pattern start, length), longest first, none shorter than ``min_match``.

    The search length starts at the pattern's length and halves down to
    ``min_match``.  At each length, windows of unmarked pattern tokens go into
    a table by their Karp-Rabin value and the text's unmarked windows are
    looked up there; hits are compared and extended over unmarked tokens, and
    a run twice the search length restarts the search at its own length.  Runs
    are marked in order of length, then text and pattern position; what earlier
    tiles leave of a run goes back into the queue at its shorter length.
    Negative tokens match nothing.
    """
    a, b = np.asarray(text, dtype=np.int64), np.asarray(pattern, dtype=np.int64)
    free_a, free_b = a >= 0, b >= 0
    tiles: list[tuple[int, int, int]] = []
    length = max(min(len(a), len(b)), min_match)

    def windows(ids: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.concatenate([[0], np.cumsum(free)])
        starts = np.flatnonzero(sums[length:] - sums[:-length] == length)
        return starts, rolling(ids, length)[starts]

    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for start, value in zip(*windows(b, free_b), strict=True):
            table[int(value)].append(int(start))
        found: set[tuple[int, int, int]] = set()
        longest = 0
        starts, values = windows(a, free_a)
        if table and len(starts):
            hit = np.isin(values, np.fromiter(table, dtype=np.uint64))
            for i, value in zip(starts[hit], values[hit], strict=True):
                for j in table[int(value)]:
                    x, y, n = int(i), j, 0
                    if x and y and free_a[x - 1] and free_b[y - 1] and a[x - 1] == b[y - 1]:
                        continue  # part of the run one token earlier
                    while x + n < len(a) and y + n < len(b) and free_a[x + n] and free_b[y + n] and a[x + n] == b[y + n]:
                        n += 1
                    if n >= length:
                        found.add((-n, x, y))
                        longest = max(longest, n)
        if longest >= 2 * length:
            length = longest
            continue
        queue = sorted(found)
        while queue:
            minus, x, y = heapq.heappop(queue)
            n = -minus
            free = free_a[x : x + n] & free_b[y : y + n]
            if free.all():
                free_a[x : x + n] = False
                free_b[y : y + n] = False
                tiles.append((x, y, n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]])))
            for s, e in zip(edges[::2], edges[1::2], strict=True):
                if e - s >= length:
                    heapq.heappush(queue, (int(s - e), x + int(s), y + int(s)))
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


class SeedIndex:
    """Token ids and seeds of one block of benchmark items."""

    def __init__(self, items: Sequence[tuple[int | None, list[str]]], min_match: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, words in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)
            if len(ids):
                by_length[min(min_match, len(ids))].append((ids, len(self.items)))
                self.items.append((item_id, ids))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, members in by_length.items():
            keys = [rolling(ids, length) for ids, _ in members]
            owner = np.repeat([i for _, i in members], [len(k) for k in keys])
            pairs = np.unique(np.stack([np.concatenate(keys), owner.astype(np.uint64)], axis=1), axis=0)
            self.seeds[length] = (pairs[:, 0].copy(), pairs[:, 1].astype(np.int64))

    def seeded(self, ids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
        """By item: the seed length and the windows of the text that share a seed with it."""
        found: dict[int, tuple[int, np.ndarray]] = {}
        for length, (keys, owners) in self.seeds.items():
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            starts = np.flatnonzero(known[length:] - known[:-length] == length) if len(ids) >= length else np.zeros(0, np.int64)
            values = rolling(ids, length)[starts] if len(starts) else np.zeros(0, np.uint64)
            first, last = np.searchsorted(keys, values, side="left"), np.searchsorted(keys, values, side="right")
            hit = np.flatnonzero(last > first)
            if len(hit):
                n = (last - first)[hit]
                at = np.repeat(first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner, start = owners[at], np.repeat(starts[hit], n)
                order = np.lexsort((start, owner))
                owner, start = owner[order], start[order]
                for item, at_item in zip(*_groups(owner), strict=True):
                    found[item] = (length, start[at_item])
        return found


def _groups(values: np.ndarray) -> tuple[list[int], list[slice]]:
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    return [int(values[e]) for e in edges[:-1]], [slice(int(s), int(e)) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def leaks_of(text: str | None, index: SeedIndex, min_match: int, threshold: float) -> Iterator[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
    """(item id, item tokens, covered tokens, tiles) of each item of which tiles cover at least ``threshold``."""
    get = index.vocabulary.get
    ids = np.array([get(w, 0) for w in tokens(text)], dtype=np.int64)
    for item, (length, starts) in index.seeded(ids).items():
        item_id, pattern = index.items[item]
        covered = np.unique((starts[:, None] + np.arange(length)).ravel())
        if np.isin(pattern, ids[covered]).sum() < threshold * len(pattern):
            continue  # tiles cannot cover enough
        breaks = np.flatnonzero(np.diff(covered) > 1) + 1
        text_ids, where = np.insert(ids[covered], breaks, -1), np.insert(covered, breaks, -1)
        tiles = greedy_tiles(text_ids, pattern, length)
        matched = sum(n for *_, n in tiles)
        if matched >= threshold * len(pattern):
            yield item_id, len(pattern), matched, sorted((int(where[x]), y, n) for x, y, n in tiles)


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The benchmark in blocks of about ``BLOCK_BYTES`` of text; only one block at a time is held."""
    total = benchmark.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks = -(-int(total) // BLOCK_BYTES)
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == block).select(item_col, text_col).collect()
        yield sorted([(r[0], tokens(r[1])) for r in rows], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated_documents(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = 0.5,
) -> DataFrame:
    """(``id_col``, item_id, item_tokens, matched_tokens, coverage, tiles): every document that tiles of a test item cover.

    Tokens are lower-cased runs of letters and digits.  A document and an item
    are compared when they share a seed of ``min_match`` tokens (the whole item
    if it is shorter); greedy string tiling then covers the item with the
    longest common runs, so passages count in whatever order they stand, and a
    pair is given out when the tiles cover at least ``threshold`` of the item.

    The benchmark is a stated query set: it is taken in blocks of bounded size,
    each sent to all tasks, and documents are scanned in place without a
    shuffle.  Null and empty texts match nothing, items without id count
    and are given out with a null ``item_id``, repeated items and documents
    give repeated rows, an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = rows.schema["__id"].dataType.simpleString()
    out = None
    for items in _item_blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(items)

        def scan(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(sent.value, min_match)
            for batch in batches:
                found = [(i, *leak) for i in range(batch.num_rows) for leak in leaks_of(batch.column(1)[i].as_py(), index, min_match, threshold)]
                if found:
                    row, item, size, matched, tiles = map(list, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(matched, pa.int32()), pa.array([m / n for m, n in zip(matched, size, strict=True)]),
                        pa.array([[{"doc_start": x, "item_start": y, "length": n} for x, y, n in t] for t in tiles], pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))),
                    ], names=["__id", "item_id", "item_tokens", "matched_tokens", "coverage", "tiles"])

        part = rows.mapInArrow(scan, f"__id {id_type}, {RESULT}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"__id {id_type}, {RESULT}")
    return out.withColumnRenamed("__id", id_col)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that no test item covers, judged as in :func:`contaminated_documents`.

    Each row is judged where it is scanned, by its own text, so null and
    repeated ids make no difference and nothing is shuffled.
    """
    place = docs.columns.index(text_col)
    out = docs
    for items in _item_blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(sent.value, min_match)
            for batch in batches:
                clean = [next(leaks_of(t.as_py(), index, min_match, threshold), None) is None for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
