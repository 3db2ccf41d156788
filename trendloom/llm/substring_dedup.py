"""Removal of byte strings that an earlier document holds, found with run-length indexes.

Every string of ``match`` bytes has a seed: of its ``SEED``-byte substrings the
one with the least hash.  Strings that follow each other and share a seed form
a context, so equal strings lie in contexts of equal seeds at equal distance
from it.  Documents are dealt into blocks; a block tells its seeds, learns
which of them other documents have too, sends the distinct contexts of those,
and learns which of their strings an earlier document holds.  Contexts are
compared in run-length indexes, one per batch of seeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.packing import open_ascending, open_pressed, press, press_ascending, split_keys, table_of
from trendloom.llm.run_index import RunIndex
from trendloom.llm.textbytes import column_bytes, span_hashes
from trendloom.runtime import require

SEED = 24
SLICE = 1 << 18
HOT_CONTEXTS = 512
INDEX_BYTES = 2 << 20
_U = np.uint64
_LOW = _U((1 << 21) - 1)


def _slices(at: np.ndarray, match: int) -> Iterator[tuple[int, int]]:
    """Byte ranges to work on: some whole texts, or parts of a long text that overlap by ``match - 1`` bytes."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, side="right")) - 1)
        lo, hi = int(at[row]), int(at[end])
        while hi - lo > 4 * SLICE:
            yield lo, lo + SLICE + match - 1
            lo += SLICE
        yield lo, hi
        row = end


def seed_runs(data: np.ndarray, at: np.ndarray, lo: int, hi: int, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, seed position, seed hash) of each context in ``data[lo:hi]``; strings are named by their start."""
    n, wide = hi - lo, match - SEED + 1
    if n < match:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    chunk = np.ascontiguousarray(data[lo:hi])
    words = np.ndarray((n - 7,), dtype="<u8", buffer=chunk, strides=(1,))
    with np.errstate(over="ignore"):
        h = words[: n - SEED + 1] * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += words[8 : n - SEED + 9] * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(31)
        h += words[16:] * _U(0x94D049BB133111EB)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: n - match + 1], least[wide - span :])
    seed = (least & _LOW).astype(np.int64)
    valid = np.ones(len(seed), dtype=bool)
    inner = at[np.searchsorted(at, lo, side="right") : np.searchsorted(at, hi, side="left")] - lo
    for b in np.unique(inner):
        valid[max(0, b - match + 1) : b] = False
    change = np.ones(len(seed), dtype=bool)
    change[1:] = (seed[1:] != seed[:-1]) | ~valid[:-1]
    stop = np.ones(len(seed), dtype=bool)
    stop[:-1] = change[1:] | ~valid[1:]
    first, last = np.flatnonzero(change & valid), np.flatnonzero(stop & valid)
    place = seed[first]
    return first + lo, last + lo, place + lo, h[place]


class Texts:
    """The rows of a block that have an id; of equal texts only the one with the least id is worked on.

    ``data``, ``at`` and ``ids`` hold those; ``row_ids`` and ``text_of`` name the id
    of every row and the text that stands for it.
    """

    def __init__(self, table: pa.Table) -> None:
        table = table.filter(table.column("id").is_valid()) if table.column("id").null_count else table
        data, at = column_bytes(table.column("data"))
        self.row_ids = table.column("id").to_numpy().astype(np.int64)
        known: dict[bytes, int] = {}
        self.text_of = np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
        raw = list(known)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.ids = np.full(len(raw), np.iinfo(np.int64).max)
        np.minimum.at(self.ids, self.text_of, self.row_ids)


SEEDS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SHARED = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())])
CONTEXTS = pa.schema([("part", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("seed", "place", "size", "doc", "flags", "text"))])
VERDICTS = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("context", "least", "mask", "hot"))])
RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
HOT, SEVERAL = 1, 2


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _tell_seeds(match: int, parts: int):
    """A block's distinct seeds with how often they occur, negative if in one document only."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        texts = Texts(table)
        data, at = texts.data, texts.at
        keys, docs = [], []
        for lo, hi in _slices(at, match):
            first, _, _, key = seed_runs(data, at, lo, hi, match)
            keys.append(key)
            docs.append((np.searchsorted(at, first, side="right") - 1).astype(np.int32))
        if not keys:
            return SEEDS.empty_table()
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(head):
            return SEEDS.empty_table()
        n = np.diff(np.append(head, len(key)))
        one = np.minimum.reduceat(doc, head) == np.maximum.reduceat(doc, head)
        n = np.minimum(n, 127)
        counts = np.where(one, -n, n).astype(np.int8)
        return table_of(SEEDS, [(p, block, press_ascending(key[head][w]), press(counts[w])) for p, w in split_keys(key[head], parts)])

    return run


def _share_seeds(table: pa.Table) -> pa.Table:
    """Tells each block which of its seeds lie in several documents, and which of them are hot."""
    keys = open_ascending(table.column("keys"))
    counts = np.concatenate(open_pressed(table.column("counts"), np.int8)).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key)
    key, row, counts = key[order], row[order], counts[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    several = (np.diff(np.append(start, len(key))) > 1) | (np.maximum.reduceat(counts, start) > 0)
    hot = np.add.reduceat(np.abs(counts), start) > HOT_CONTEXTS
    chosen = several[group]
    key, row, hot = key[chosen], row[chosen], hot[group][chosen]
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(len(keys) + 1))
    blocks = table.column("block").to_pylist()
    return table_of(SHARED, [(blocks[i], press_ascending(key[w]), press(hot[w])) for i in range(len(keys)) if len(w := order[edges[i] : edges[i + 1]])])


def _lookup(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values, at


def _strings(first: np.ndarray, last: np.ndarray, place: np.ndarray, key: np.ndarray, hot: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """(start, end, seed position, seed, hot) of what is compared: whole contexts, of hot seeds each string by itself; ordered by start."""
    n = np.where(hot, last - first + 1, 1)
    source = np.repeat(np.arange(len(first)), n)
    start = first[source] + np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
    end = np.where(hot[source], start, last[source]) + match
    return start, end, place[source], key[source], hot[source]


def _tell_contexts(match: int, parts: int):
    """A block's distinct contexts of shared seeds, each with the least id that has it."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return CONTEXTS.empty_table()
        block = table.column("block")[0].as_py()
        known, hot = _shared_seeds(shared)
        texts = Texts(table)
        data, at, ids = texts.data, texts.at, texts.ids
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in _slices(at, match):
            first, last, place, key = seed_runs(data, at, lo, hi, match)
            has, where = _lookup(known, key)
            start, end, place, key, is_hot = _strings(first[has], last[has], place[has], key[has], hot[where[has]], match)
            if len(start):
                found.append((start, end, place - start, key, is_hot, span_hashes(data, start, end), ids[np.searchsorted(at, start, side="right") - 1]))
        if not found:
            return CONTEXTS.empty_table()
        start, end, place, key, is_hot, context, doc = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((doc, context))
        head = np.flatnonzero(np.concatenate([[True], context[order][1:] != context[order][:-1]]))
        several = np.maximum.reduceat(doc[order], head) != doc[order][head]
        chosen = order[head]
        start, end, place, key, is_hot, context, doc = (c[chosen] for c in (start, end, place, key, is_hot, context, doc))
        route = np.where(is_hot, context, key)
        flags = (is_hot * HOT + several * SEVERAL).astype(np.uint8)
        rows = []
        for p, w in split_keys(route, parts):
            size = end[w] - start[w]
            text = data[np.repeat(start[w], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            rows.append((p, block, *map(press, (key[w], place[w].astype(np.uint8), size.astype(np.uint8), doc[w], flags[w], text))))
        return table_of(CONTEXTS, rows)

    return run


def _shared_seeds(shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(open_ascending(shared.column("keys")))
    hot = np.concatenate(open_pressed(shared.column("hot"), bool))
    order = np.argsort(keys)
    return keys[order], hot[order]


def earlier_strings(text: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, group: np.ndarray, rank: np.ndarray, match: int) -> np.ndarray:
    """Bit s of entry c: string s of context c is in a context of its group with a lower rank.

    Contexts are split by the bits of their rank: at each bit, those with the
    bit set are patterns for those of the sibling half without it, so every
    pair of ranks meets at exactly one bit.  In both, the seed is replaced by
    one symbol that names group and halves; all strings hold the seed, so
    matches of full length never leave their halves and one index serves all.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    refs, pats = [], []
    for bit in range(int(rank.max(initial=0)).bit_length()):
        half = (rank >> bit) & 1
        pair = (group * 64 + bit) * (1 << 20) + (rank >> (bit + 1))
        refs.append((np.flatnonzero(half == 0), pair[half == 0]))
        pats.append((np.flatnonzero(half == 1), pair[half == 1]))
    if not refs:
        return out
    ref, ref_pair = (np.concatenate(c) for c in zip(*refs, strict=True))
    pat, pat_pair = (np.concatenate(c) for c in zip(*pats, strict=True))
    pairs = np.intersect1d(ref_pair, pat_pair)
    keep_r, keep_p = np.isin(ref_pair, pairs), np.isin(pat_pair, pairs)
    ref, pat = ref[keep_r], pat[keep_p]
    if not len(pairs):
        return out
    ref_symbol, pat_symbol = (257 + np.searchsorted(pairs, p) for p in (ref_pair[keep_r], pat_pair[keep_p]))

    def spelled(item: np.ndarray, symbol: np.ndarray, closed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = size[item] - SEED + 1 + closed
        begin = np.cumsum(length) - length
        inner = np.arange(length.sum()) - np.repeat(begin, length)
        hole = np.repeat(place[item], length)
        source = np.repeat(start[item], length) + inner + np.where(inner > hole, SEED - 1, 0)
        letters = text[np.minimum(source, len(text) - 1)].astype(np.int64) + 1
        letters[begin + place[item]] = symbol
        if closed:
            letters[begin + length - 1] = 0
        return letters, begin, length

    letters, begin, _ = spelled(ref, ref_symbol, 1)
    index = RunIndex(letters, begin)
    letters, begin, length = spelled(pat, pat_symbol, 0)
    statistics = index.matching_statistics(letters, begin, length)
    wide = match - SEED + 1
    hit = np.flatnonzero(statistics >= wide)
    owner = np.searchsorted(begin, hit, side="right") - 1
    np.bitwise_or.at(out, pat[owner], _U(1) << (hit - begin[owner]).astype(np.uint64))
    return out


def _judge_contexts(match: int):
    """Contexts of one part to, per block, the least id of each and the strings an earlier document holds."""

    def run(table: pa.Table) -> pa.Table:
        kinds = {"seed": np.uint64, "place": np.uint8, "size": np.uint8, "doc": np.int64, "flags": np.uint8, "text": np.uint8}
        raw = {c: open_pressed(table.column(c), t) for c, t in kinds.items()}
        row = np.repeat(np.arange(table.num_rows), [len(x) for x in raw["seed"]])
        seed, place, size, doc, flags, text = (np.concatenate(raw[c]) for c in kinds)
        place, size = place.astype(np.int64), size.astype(np.int64)
        start = np.cumsum(size) - size
        context = span_hashes(text, start, start + size)
        route = np.where(flags & HOT > 0, context, seed)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        inside = [words[start + place + k] for k in (0, 8, 16)]
        order = np.lexsort((doc, context, *inside, route))
        ordered = lambda c: c[order]
        new_group = np.zeros(len(order), bool)
        new_group[0] = True
        for c in (route, *inside):
            new_group[1:] |= ordered(c)[1:] != ordered(c)[:-1]
        new_context = new_group.copy()
        new_context[1:] |= ordered(context)[1:] != ordered(context)[:-1]
        group, entry = np.cumsum(new_group) - 1, np.cumsum(new_context) - 1
        head = np.flatnonzero(new_context)
        of_group, least = group[head], ordered(doc)[head]
        mask = np.zeros(len(head), dtype=np.uint64)
        crowded = np.flatnonzero(np.bincount(of_group)[of_group] > 1)
        by_doc = crowded[np.lexsort((least[crowded], of_group[crowded]))]
        if len(by_doc):
            g, d = of_group[by_doc], least[by_doc]
            opened = np.concatenate([[True], g[1:] != g[:-1]])
            risen = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) & ~opened[1:]]))
            first_of = np.maximum.accumulate(np.where(opened, np.arange(len(g)), 0))
            rank = risen - risen[first_of]
            at, length, hole = start[order[head[by_doc]]], size[order[head[by_doc]]], place[order[head[by_doc]]]
            copies = np.maximum(1, np.frompyfunc(int.bit_length, 1, 1)(rank).astype(np.int64))
            total = np.cumsum(length * copies)
            begin = 0
            while begin < len(g):
                end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + INDEX_BYTES, side="right"))
                end = max(end, begin + 1)
                while end < len(g) and not opened[end]:
                    end += 1
                w = slice(begin, end)
                mask[by_doc[w]] = earlier_strings(text, at[w], length[w], hole[w], g[w], rank[w], match)
                begin = end
        told = (mask != 0) | (np.bincount(entry) > 1)
        wanted = told[entry] | (ordered(flags) & SEVERAL > 0)
        row, entry, context, seed, flags = ordered(row)[wanted], entry[wanted], ordered(context)[wanted], ordered(seed)[wanted], ordered(flags)[wanted]
        by_row = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[by_row], np.arange(table.num_rows + 1))
        blocks = table.column("block").to_pylist()
        rows = []
        for i in range(table.num_rows):
            w = by_row[edges[i] : edges[i + 1]]
            if len(w):
                hot = np.unique(seed[w][flags[w] & HOT > 0])
                rows.append((blocks[i], *map(press, (context[w], least[entry[w]], mask[entry[w]].astype(np.uint32), hot))))
        return table_of(VERDICTS, rows)

    return run


def removed_bytes(data: np.ndarray, at: np.ndarray, ids: np.ndarray, verdicts: pa.Table, match: int) -> np.ndarray:
    """Which bytes of a block go."""
    gone = np.zeros(len(data) + 1, dtype=np.int32)
    if verdicts.num_rows:
        kinds = {"context": np.uint64, "least": np.int64, "mask": np.uint32, "hot": np.uint64}
        context, least, mask, hot = (np.concatenate(open_pressed(verdicts.column(c), t)) for c, t in kinds.items())
        order = np.argsort(context)
        context, least, mask = context[order], least[order], mask[order].astype(np.uint64)
        hot = np.unique(hot)
        for lo, hi in _slices(at, match):
            first, last, place, key = seed_runs(data, at, lo, hi, match)
            start, end, *_ = _strings(first, last, place, key, _lookup(hot, key)[0], match)
            has, found = _lookup(context, span_hashes(data, start, end))
            start, end, found = start[has], end[has], found[has]
            later = ids[np.searchsorted(at, start, side="right") - 1] > least[found]
            np.add.at(gone, start[later], 1)
            np.add.at(gone, end[later], -1)
            start, bits = start[~later], mask[found[~later]]
            for s in range(match - SEED + 1):
                on = start[(bits >> _U(s)) & _U(1) > 0] + s
                np.add.at(gone, on, 1)
                np.add.at(gone, on + match, -1)
    return np.cumsum(gone[:-1]) > 0


def _kept_parts(table: pa.Table, verdicts: pa.Table, match: int) -> Iterator[tuple[int | None, int, int, int, bytes]]:
    """(id, bytes, removed bytes, removed runs, what is kept) of each row of a block."""
    texts = Texts(table)
    gone = removed_bytes(texts.data, texts.at, texts.ids, verdicts, match)
    own = []
    for s, e in zip(texts.at[:-1], texts.at[1:], strict=True):
        out, text = gone[s:e], texts.data[s:e]
        spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if e > s else 0
        own.append((int(e - s), int(out.sum()), spans, text[~out].tobytes() if spans else text.tobytes()))
    for row_id, text in zip(texts.row_ids.tolist(), texts.text_of.tolist(), strict=True):
        size = own[text][0]
        copied = row_id > texts.ids[text] and size >= match
        yield (row_id, size, size, 1, b"") if copied else (row_id, *own[text])
    for raw in table.filter(table.column("id").is_null()).column("data").to_pylist():
        yield None, len(raw), 0, 0, raw


def _remove(match: int):
    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        return table_of(RESULT, [(*row[:4], hashlib.sha256(row[4]).hexdigest()) for row in _kept_parts(table, verdicts, match)])

    return run


def _kept(match: int):
    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        return table_of(pa.schema([("id", pa.int64()), ("kept", pa.binary())]), [(row[0], row[4]) for row in _kept_parts(table, verdicts, match)])

    return run


def _block(texts: DataFrame, blocks: int) -> Column:
    """Equal texts share a block, unless they are too many for one: those are dealt by id."""
    limit = max(64, texts.count() // (4 * blocks))
    name = F.xxhash64("data")
    many = [r["name"] for r in texts.select(name.alias("name")).groupBy("name").count().where(F.col("count") > limit).select("name").collect()]  # at most 4 * blocks
    key = F.when(name.isin(many), F.xxhash64("id")).otherwise(name) if many else name
    return F.pmod(key, F.lit(blocks)).cast("int")


def _judged(docs: DataFrame, id_col: str, text_col: str, match: int) -> tuple[DataFrame, DataFrame]:
    """(texts with their block, verdicts)."""
    require(SEED + 8 <= match <= SEED + 31, f"match must be from {SEED + 8} to {SEED + 31} bytes")
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    texts = texts.withColumn("block", _block(texts, n))
    seeds = texts.groupBy("block").applyInArrow(_tell_seeds(match, n), _ddl(SEEDS))
    shared = seeds.groupBy("part").applyInArrow(_share_seeds, _ddl(SHARED))
    contexts = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_tell_contexts(match, n), _ddl(CONTEXTS))
    verdicts = contexts.groupBy("part").applyInArrow(_judge_contexts(match), _ddl(VERDICTS))
    return texts, verdicts


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", match: int = 50) -> DataFrame:
    """(``id_col``, n_bytes, n_removed, n_spans, kept_sha256) per document.

    A byte is removed when it lies in a string of ``match`` bytes that also
    starts in a document with a smaller id; strings may overlap, never cross
    documents, and are judged on the texts as given.  ``n_spans`` counts
    maximal removed runs, ``kept_sha256`` names the other bytes in their order.

    Null texts are empty; texts shorter than ``match`` lose nothing.  Rows that
    share an id lose nothing to each other.  A row without id is given back
    unchanged and takes nothing from others.  An empty table gives an empty
    result.  The text is shuffled once; equal texts share a block and are
    worked on once (a text with more copies than a quarter of a block's share
    of rows is dealt by id instead); blocks exchange seeds, distinct contexts
    of shared seeds, and verdicts.  A context that a third of all documents
    have goes out once per block; a seed with more than ``HOT_CONTEXTS``
    occurrences is split by whole strings.
    """
    texts, verdicts = _judged(docs, id_col, text_col, match)
    out = texts.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_remove(match), _ddl(RESULT))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def kept_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", match: int = 50) -> DataFrame:
    """(``id_col``, kept): the bytes that :func:`repeated_bytes` leaves of each document."""
    texts, verdicts = _judged(docs, id_col, text_col, match)
    out = texts.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_kept(match), "id long, kept binary")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
