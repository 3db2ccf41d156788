"""N-gram Jaccard join with a token-group matrix: group similar documents, bound by the groups' token unions, open what qualifies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.components import connected_components
from trendloom.llm.packing import open_ascending, open_pressed, press, press_ascending, split_keys, table_of
from trendloom.llm.textbytes import LOWER, mix, slices, span_hashes, text_of, word_spans
from trendloom.runtime import cut_lineage, require

CLASS_RATIO = 1.3
GROUP_DOCS = 32
BLOCK_DOCS = 1024
SENT_IDS = 1_000_000
PARTITION_TEXT = 16_000_000
SIGNED_SETS, SIGNED_TOKENS = 1000, 1 << 19
INFO, SIGNATURE, CANDIDATE, EQUAL, TOKENS, ANSWER = 0, 1, 2, 3, 4, 5
_U = np.uint64


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a word sequence's shingles; a shorter sequence is one shingle, none is none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, width if len(words) < size else 0, dtype=np.uint64)
        for k in range(width):
            total = mix(total + words[k : k + len(total)])
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def shingle_sets(batch: pa.RecordBatch | pa.Table, text: str, size: int) -> Iterator[tuple[pa.RecordBatch | pa.Table, list[np.ndarray]]]:
    """Row slices with the shingle set of each row."""
    for part, data, at in slices(batch, text):
        low = LOWER[data]
        starts, ends = word_spans(low, at)
        hashes = span_hashes(low, starts, ends)
        edges = np.searchsorted(starts, at)
        yield part, [shingle_hashes(hashes[s:e], size) for s, e in zip(edges[:-1], edges[1:], strict=True)]


@dataclass(frozen=True)
class Scheme:
    """Splits sets of a class of sizes so that two sets that link agree in a whole part.

    With ``percent`` p, linked sets of sizes a and b differ in at most
    (a + b)(100 - p) / (100 + p) tokens.  Tokens are dealt by hash into more
    parts than that, so enough parts hold the same tokens in both sets; the
    spare parts make up for empty ones, which are no sign of likeness.
    """

    number: int
    parts: int
    spare: int


class Schemes:
    def __init__(self, percent: int, ratio: float = CLASS_RATIO) -> None:
        self.percent = percent
        self.limits = [1]
        while self.limits[-1] < 1 << 40:
            self.limits.append(max(self.limits[-1] + 1, int(self.limits[-1] * ratio)))
        self.cache: dict[int, Scheme] = {}

    def scheme(self, number: int) -> Scheme:
        if number not in self.cache:
            largest = self.limits[number + 1] - 1
            differ = 2 * largest * (100 - self.percent) // (100 + self.percent)
            if differ == 0:
                self.cache[number] = Scheme(number, 1, 0)
            else:
                smallest, spare = self.limits[number] * self.percent / 100, 2
                for _ in range(4):
                    parts = differ + 1 + spare
                    spare = 2 + int(1.5 * parts * np.exp(-smallest / parts))
                self.cache[number] = Scheme(number, differ + 1 + spare, spare)
        return self.cache[number]

    def of(self, size: int) -> list[Scheme]:
        """The schemes of a set's own class and of all classes up to the largest set that may link."""
        own, last = np.searchsorted(self.limits, [size, size * 100 // self.percent], side="right") - 1
        return [self.scheme(n) for n in range(int(own), int(last) + 1)]


def signatures(sets: list[np.ndarray], schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of every part that counts: all non-empty ones, and the empty ones of a set that has too many."""
    jobs = [(i, s) for i, tokens in enumerate(sets) if len(tokens) for s in schemes.of(len(tokens))]
    if not jobs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = np.array([len(sets[i]) for i, _ in jobs])
    parts = np.array([s.parts for _, s in jobs])
    base = np.cumsum(parts) - parts
    tokens = np.concatenate([sets[i] for i, _ in jobs])
    with np.errstate(over="ignore"):
        salted = mix(tokens + np.repeat(np.array([s.number for _, s in jobs], dtype=np.uint64) * _U(0x9E3779B97F4A7C15), lengths))
        slot = np.repeat(base, lengths) + (salted % np.repeat(parts, lengths).astype(np.uint64)).astype(np.int64)
        again = mix(salted)
        low = np.bincount(slot, weights=(again & _U(0xFFFFFFFF)).astype(float), minlength=int(parts.sum())).astype(np.uint64)
        high = np.bincount(slot, weights=(again >> _U(32)).astype(float), minlength=int(parts.sum())).astype(np.uint64)
        filled = np.bincount(slot, minlength=int(parts.sum()))
        job = np.repeat(np.arange(len(jobs)), parts)
        number = np.array([s.number for _, s in jobs], dtype=np.uint64)[job]
        sign = mix(mix(low + (np.arange(len(job)) - base[job]).astype(np.uint64) * _U(0xD6E8FEB86659FD93)) + high * _U(0xA0761D6478BD642F) + number * _U(0xE7037ED1A0B428DB))
    empty = np.bincount(job, weights=filled == 0, minlength=len(jobs))
    counted = (filled > 0) | (empty > np.array([s.spare for _, s in jobs]))[job]
    return np.array([i for i, _ in jobs])[job[counted]], sign[counted]


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per key its least document, and (document, least) for all others, distinct."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    least = doc[first][np.cumsum(first) - 1] if len(key) else doc
    other = doc != least
    pairs = np.unique(np.stack([doc[other], least[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return key[first], doc[first], pairs[:, 0], pairs[:, 1]


MET = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("tokens", pa.binary())])
FIRST = pa.schema([*MET, ("keys", pa.binary()), ("docs", pa.binary())])
SLOTS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("slots", pa.binary()), ("often", pa.binary())])
COMMON = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("common", pa.binary())])


def _rows(kind: int, a: np.ndarray, b: np.ndarray, schema: pa.Schema = FIRST) -> pa.Table:
    known = [pa.array(np.full(len(a), kind, np.int8)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))]
    return pa.table([*known, *(pa.nulls(len(a), f.type) for f in list(schema)[3:])], schema=schema)


class Sets:
    """The shingle sets of a block; equal sets stand together under their least id."""

    def __init__(self, table: pa.Table, shingle: int) -> None:
        self.ids, self.sizes, self.equal = [], [], []
        least: dict[bytes, int] = {}
        held: dict[bytes, np.ndarray] = {}
        members: list[tuple[int, bytes]] = []
        for part, sets in shingle_sets(table, "text", shingle):
            for row_id, tokens in zip(part.column("id").to_pylist(), sets, strict=True):
                self.ids.append(row_id)
                self.sizes.append(len(tokens))
                if len(tokens):
                    name = hash_of(tokens)
                    held.setdefault(name, tokens)
                    least[name] = min(row_id, least.get(name, row_id))
                    members.append((row_id, name))
        self.equal = sorted({(i, least[n]) for i, n in members if i != least[n]})
        self.own = [least[n] for n in held]
        self.tokens = list(held.values())

    def slots(self, bits: int) -> np.ndarray:
        """The slot of every token, set after set."""
        every = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
        return mix(every + _U(7)) >> _U(64 - bits)


def _part_edges(slots: np.ndarray, bits: int, part_bits: int) -> np.ndarray:
    return np.searchsorted(slots, np.arange((1 << part_bits) + 1, dtype=np.uint64) << _U(bits - part_bits))


def _tell_slots(shingle: int, bits: int, part_bits: int):
    """A block's slots in order, and which of them it fills more than once."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        slots, n = np.unique(Sets(table, shingle).slots(bits), return_counts=True)
        edges = _part_edges(slots, bits, part_bits)
        return table_of(SLOTS, [(p, block, press_ascending(slots[edges[p] : edges[p + 1]]), press(np.packbits(n[edges[p] : edges[p + 1]] > 1))) for p in np.flatnonzero(np.diff(edges)).tolist()])

    return run


def _tell_common(table: pa.Table) -> pa.Table:
    """For each block, which of its slots are filled more than once by all blocks together."""
    slots = open_ascending(table.column("slots"))
    often = np.concatenate([np.unpackbits(o, count=len(s)) for o, s in zip(open_pressed(table.column("often"), np.uint8), slots, strict=True)])
    _, place, n = np.unique(np.concatenate(slots), return_inverse=True, return_counts=True)
    common = np.bincount(place, weights=often, minlength=len(n)) + n > 1
    part = table.column("part")[0].as_py()
    each = np.split(common[place], np.cumsum([len(x) for x in slots])[:-1])
    return table_of(COMMON, [(b, part, press(np.packbits(c))) for b, c in zip(table.column("block").to_pylist(), each, strict=True)])


def signed_together(lengths: np.ndarray) -> list[np.ndarray]:
    """Places of the sets that are signed at one time: few sets, and few tokens unless a set is long itself."""
    step = np.cumsum(lengths) // SIGNED_TOKENS + np.arange(len(lengths)) // SIGNED_SETS
    return np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(step)) + 1)


def partitions_for(text_bytes: int, configured: int) -> int:
    """The partitions of the exchanges: those of the session, more where a partition would hold more than ``PARTITION_TEXT``."""
    return max(configured, -(-text_bytes // PARTITION_TEXT))


def _first_pass(shingle: int, percent: int, bits: int, part_bits: int, parts: int):
    """A block's texts to (id, set size), equal sets, and of the sets that may link at all their tokens and signatures.

    A set links only if ``percent`` of its tokens are in another set too; slots
    that several tokens share can only let more sets pass.
    """
    schemes = Schemes(percent)

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return FIRST.empty_table()
        sets = Sets(texts, shingle)
        block = texts.column("block")[0].as_py()
        every = sets.slots(bits)
        slots = np.unique(every)
        edges = _part_edges(slots, bits, part_bits)
        common = np.zeros(len(slots), dtype=bool)
        for p, c in zip(told.column("part").to_pylist(), open_pressed(told.column("common"), np.uint8), strict=True):
            common[edges[p] : edges[p + 1]] = np.unpackbits(c, count=int(edges[p + 1] - edges[p]))
        lengths = np.array([len(t) for t in sets.tokens], dtype=np.int64)
        shared = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=common[np.searchsorted(slots, every)], minlength=len(lengths))
        chosen = np.flatnonzero(100 * shared >= percent * lengths)
        out = [_rows(INFO, np.array(sets.ids, np.int64), np.array(sets.sizes, np.int64))]
        if sets.equal:
            out.append(_rows(EQUAL, *np.array(sets.equal, np.int64).T))
        if len(chosen):
            own = np.array(sets.own, np.int64)[chosen]
            out.append(table_of(FIRST, [(TOKENS, int(i), None, press_ascending(sets.tokens[c]), None, None) for i, c in zip(own, chosen, strict=True)]))
            for at in signed_together(lengths[chosen]):
                number, sign = signatures([sets.tokens[c] for c in chosen[at]], schemes)
                key, doc, a, b = _stars(sign, own[at][number])
                out.append(_rows(CANDIDATE, a, b))
                out.append(table_of(FIRST, [(SIGNATURE, p, block, None, press_ascending(key[w]), press(doc[w])) for p, w in split_keys(key, parts)]))
        return pa.concat_tables(out)

    return run


def hash_of(tokens: np.ndarray) -> bytes:
    """A 128-bit name of a set (its tokens are 64-bit hashes already)."""
    with np.errstate(over="ignore"):
        again = mix(tokens)
        return b"%d %d %d" % (len(tokens), int(np.add.reduce(again)), int(np.add.reduce(mix(again + _U(1)))))


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of one partition to an answer for each block: its documents and the least ones they met; other rows pass.

    Documents that link meet in nearly every partition, so the pairs go back
    packed, and the block gives out what all partitions told it once.
    """
    keys, docs, blocks = [], [], []
    for batch in batches:
        kind = batch.column(0).to_numpy()
        sign = kind == SIGNATURE
        if not sign.all():
            yield batch.select(MET.names).filter(pa.array(~sign))
        packed = pa.table(batch.filter(pa.array(sign)))
        opened = open_ascending(packed.column("keys"))
        keys += opened
        docs += open_pressed(packed.column("docs"), np.int64)
        blocks += [np.full(len(k), b, np.int32) for k, b in zip(opened, packed.column("b").to_pylist(), strict=True)]
    if not keys:
        return
    doc, block = np.concatenate(docs), np.concatenate(blocks)
    *_, a, least = _stars(np.concatenate(keys), doc)
    order = np.argsort(doc, kind="stable")
    home = block[order][np.searchsorted(doc[order], a)]
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
    answers = [(ANSWER, int(home[order[x]]), None, press(np.concatenate([a[order[x:y]], least[order[x:y]]]))) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    if answers:
        yield from table_of(MET, answers).to_batches()


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(table: pa.Table) -> pa.Table:
    """All answers to one block as a spanning forest of the pairs in them: fewer pairs than documents, the same components."""
    pairs = [p.reshape(2, -1) for p in open_pressed(table.column("tokens"), np.int64)]
    a, b = np.concatenate(pairs, axis=1)
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    met = np.unique(place.reshape(2, -1).T, axis=0)
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for x, y in met.tolist():
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            kept.append((x, y))
    chosen = np.array(kept, dtype=np.int64).reshape(-1, 2)
    return pa.table([pa.array(names[chosen[:, 0]]), pa.array(names[chosen[:, 1]])], schema=PAIRS)


class TokenGroups:
    """Groups of documents with each group's token union, over token numbers local to one task."""

    def __init__(self, sets: list[np.ndarray], members: list[int]) -> None:
        ordered = sorted(members, key=lambda i: (len(sets[i]), tuple(sets[i][:2])))
        self.members = [ordered[i : i + GROUP_DOCS] for i in range(0, len(ordered), GROUP_DOCS)]
        self.tokens = [np.concatenate([sets[i] for i in g]) for g in self.members]
        self.owner = [np.repeat(np.arange(len(g)), [len(sets[i]) for i in g]) for g in self.members]
        self.union = [np.unique(t) for t in self.tokens]
        self.sizes = [np.array([len(sets[i]) for i in g]) for g in self.members]


def linked_pairs(sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links between ``left`` and ``right`` set numbers that join components, enough to give exactly the components of all links.

    A query opens a group only if its overlap with the group's token union
    reaches what a link needs, ``percent`` of its own size; members already in
    the query's component are not compared again.
    """
    if not left or not right:
        return
    chosen = sorted({*left, *right})
    _, local = np.unique(np.concatenate([sets[i] for i in chosen]), return_inverse=True)
    cut = np.split(local, np.cumsum([len(sets[i]) for i in chosen])[:-1])
    numbered = dict(zip(chosen, cut, strict=True))
    small = [numbered.get(i, np.zeros(0, np.int64)) for i in range(len(sets))]
    groups = TokenGroups(small, right)
    root = {i: i for i in chosen}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(int(local.max()) + 1, dtype=bool)
    for q in left:
        mark[small[q]] = True
        size = len(small[q])
        for members, tokens, owner, union, sizes in zip(groups.members, groups.tokens, groups.owner, groups.union, groups.sizes, strict=True):
            if 100 * sizes[0] * percent > 10_000 * size or 100 * size * percent > 10_000 * sizes[-1]:
                continue  # no member's size allows a link
            home = find(q)
            if all(find(m) == home for m in members):
                continue
            if 100 * int(mark[union].sum()) < percent * size:
                continue
            shared = np.bincount(owner[mark[tokens]], minlength=len(members))
            for at in np.flatnonzero(100 * shared >= percent * (sizes + size - shared)):
                a, b = find(q), find(members[at])
                if a != b:
                    root[a] = b
                    yield q, members[at]
        mark[small[q]] = False


def _verify(percent: int):
    """Rows (group, i, j, side, id, tokens), sorted by task, to the links that join components."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sets = open_ascending(pa.chunked_array([pa.array([r[5] for r in rows], pa.binary())]))
        i, j = rows[0][1:3]
        left, right = ([k for k, r in enumerate(rows) if r[3] == side] for side in (i, j))
        links = list(linked_pairs(sets, left, right, percent))
        return pa.RecordBatch.from_arrays([pa.array([rows[x][4] for x, _ in links], pa.int64()), pa.array([rows[y][4] for _, y in links], pa.int64())], schema=out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(``id_col``, n_shingles, component_id): each row's shingle set size and the least id its links lead to.

    Texts are lower-cased (A-Z) and split at ASCII white space; a document's
    set holds its distinct shingles of ``shingle`` words (the whole sequence
    if it is shorter).  Two documents link when 100 * intersection >= percent *
    union; no link between different sets is lost, whatever the group's size.

    Blocks of documents first tell each other which tokens occur more than
    once; only sets that share ``percent`` of their tokens go on.  Those whose
    sets may link agree in a part of their tokens (see :class:`Scheme`);
    meeting there puts similar documents into groups.  Each block merges its
    own equal sets and meetings first, so copies go out once per block.  A block's texts are bounded, whatever the session's
    number of shuffle partitions.  Groups above ``BLOCK_DOCS`` documents are cut
    into blocks and every pair of blocks is a task of its own.

    Null texts and texts without words have no shingles and link with nothing.
    Rows that share an id are one document with several sets.  A null id is
    given back without component.  Ids may be of any type that can be ordered; those that are no whole numbers
    are numbered first.  An empty table gives an empty result.
    """
    require(50 < percent <= 100 and shingle > 0, "percent must be above 50, shingle positive")
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return _components_by_number(docs, id_col, text_col, shingle, percent)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = texts.where("id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions_for(int(size), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part_bits = max(1, (n - 1).bit_length())
    bits = max(part_bits, 16, int(size).bit_length())  # some slots for each token
    blocks = known.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(2 * n)).cast("int"))
    slots = blocks.groupBy("block").applyInArrow(_tell_slots(shingle, bits, part_bits), "part int, block int, slots binary, often binary")
    common = slots.groupBy("part").applyInArrow(_tell_common, "block int, part int, common binary")
    first = blocks.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(
        _first_pass(shingle, percent, bits, part_bits, n), "kind byte, a long, b long, tokens binary, keys binary, docs binary")
    facts = cut_lineage(first.repartition(n, "a").mapInArrow(_meet, "kind byte, a long, b long, tokens binary"), "meetings")
    answers = facts.where(F.col("kind") == ANSWER).select(F.col("a").alias("block"), "tokens")
    met = answers.groupBy("block").applyInArrow(_forest, "a long, b long")
    candidates = facts.where(F.col("kind") == CANDIDATE).select("a", "b").unionByName(met)
    groups = connected_components(candidates)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = (F.ceil(F.col("size") / F.lit(BLOCK_DOCS))).cast("int")
    placed = groups.join(sizes, "component").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", F.col("component").alias("grp"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    tokens = facts.where(F.col("kind") == TOKENS).select(F.col("a").alias("id"), "tokens")
    sets = tokens.join(tasks.hint("merge"), "id").select("grp", "i", "j", "side", "id", "tokens")
    links = sets.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_verify(percent), "a long, b long")
    equal = facts.where(F.col("kind") == EQUAL).select("a", "b")
    components = connected_components(links.unionByName(equal)).withColumnRenamed("id", "__member")
    info = facts.where(F.col("kind") == INFO).select(F.col("a").alias("__id"), F.col("b").alias("n_shingles"))
    out = info.join(components, F.col("__id") == F.col("__member"), "left").select(
        F.col("__id").cast(id_type).alias(id_col), "n_shingles", F.coalesce("component", "__id").cast(id_type).alias("component_id"))
    without = texts.where("id IS NULL").mapInArrow(_count_only(shingle), "n_shingles long")
    return out.unionByName(without.select(F.lit(None).cast(id_type).alias(id_col), "n_shingles", F.lit(None).cast(id_type).alias("component_id")))


def _count_only(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch, "text", shingle):
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64())], names=["n_shingles"])

    return run


def _components_by_number(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """As :func:`jaccard_components`, for ids that are no whole numbers: equal ids get one number, null ids none."""
    named = docs.select(F.col(id_col).alias("__name"), F.col(text_col).alias("__text"))
    names = cut_lineage(named.where("__name IS NOT NULL").select("__name").distinct().withColumn("__number", F.monotonically_increasing_id()), "names")
    found = jaccard_components(named.join(names, "__name", "left").select("__number", "__text"), id_col="__number", text_col="__text", shingle=shingle, percent=percent)
    rows = cut_lineage(found.join(names, "__number", "left"), "numbered")
    least = rows.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("__name").alias("__least"))
    return rows.join(least, "component_id", "left").select(F.col("__name").alias(id_col), "n_shingles", F.col("__least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each group of linked rows: that with the least id, null ids last.

    Every row is a document of its own, whether its id is null or repeated.
    """
    rows = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    components = jaccard_components(rows.select("__row", text_col), id_col="__row", text_col=text_col, **options)
    linked = cut_lineage(components.where(F.col("__row") != F.col("component_id")).select("__row", F.col("component_id").alias("__group")), "linked")
    members = linked.unionByName(linked.select(F.col("__group").alias("__row"), "__group").distinct())
    named = members.join(rows.select("__row", F.col(id_col).alias("__name")), "__row")
    first = named.groupBy("__group").agg(F.min(F.struct(F.col("__name").isNull(), "__name", "__row")).alias("__first"))
    losers = cut_lineage(named.join(first, "__group").where(F.col("__row") != F.col("__first")["__row"]).select("__row"), "losers")
    # Sent to all tasks only while it is counted to be small; beyond that the texts are shuffled.
    sent = F.broadcast(losers) if losers.count() <= SENT_IDS else losers
    return rows.join(sent, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
