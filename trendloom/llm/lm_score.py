"""Language-model scores: a causal self-attention model over subword ids, trained and run in NumPy.

The next subword's probability is that of its class, given the last ``WINDOW``
subwords, times its share of the class after the subword before it.  Attention
gives the first, as a change of the class's counted share after the subword
before.  Shares are counted over all training texts; the attention weights are
fitted by gradient descent on all subwords of all training texts, by trainers
whose weights are averaged after each round.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.packing import open_ascending, open_pressed, press, press_ascending, split_keys, table_of
from trendloom.llm.textbytes import LOWER, mix, slices, span_hashes, word_spans
from trendloom.runtime import cut_lineage

WINDOW = 24
OVERLAP = 4
WIDTH = 16
CLASSES = 64
FREQUENT = 2048
BLOCK_BYTES = 8 << 20
#: Words of a block whose subwords are laid out at once where windows need not be mixed.
PIECE_WORDS = 1 << 18
ROUNDS = 1
BATCH = 512
#: Windows worked on at once.
PART_WINDOWS = 128
#: Attention scores up to this size go through exp as they are.
SAFE_SCORE = 60.0
TRAINER_WINDOWS = 4096
#: Trainers' weights travel and are averaged in pieces of so many numbers.
PIECE = 8192
#: Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Subwords:
    """Byte-level subword ids of words, each taken with a space before it; one more id ends a text."""

    def __init__(self, ranks: bytes) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.opens = np.zeros(self.end + 1, dtype=bool)
        for token, rank in table.items():
            self.opens[rank] = token[:1] == b" "

    def encode(self, words: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of ``count`` words, each with a space before it."""
        ids = np.array(self.encoding.encode_ordinary(words.decode("utf-8", "replace")), dtype=np.int64)
        first = np.flatnonzero(self.opens[ids])
        if len(first) != count:  # a replaced byte has merged with a space
            each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words[1:].split(b" ")]
            return np.array([i for e in each for i in e], dtype=np.int64), np.array([len(e) for e in each])
        return ids, np.diff(np.append(first, len(ids)))


_LOADED: dict[int, Subwords] = {}


def subwords(ranks: bytes) -> Subwords:
    key = hash(ranks)
    if key not in _LOADED:
        _LOADED[key] = Subwords(ranks)
    return _LOADED[key]


# ---------------------------------------------------------------- windows

def windows_of(size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """How many windows, each ``OVERLAP`` subwords into the one before, cover texts of ``size`` subwords."""
    return 1 + np.maximum(0, -(-(size - window) // (window - OVERLAP)))


def window_places(at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in it, first place) of every window of a stream with texts at the offsets ``at``."""
    many = windows_of(np.diff(at), window)
    text = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, number, at[:-1][text] + number * (window - OVERLAP)


# ---------------------------------------------------------------- blocks

BLOCKS = pa.schema([("block", pa.int64()), ("trained", pa.int64()), ("windows", pa.int64()), *((c, pa.binary()) for c in ("ids", "without_id", "train", "words", "index", "keys", "counts", "tokens", "lengths"))])


def _make_blocks(sent):
    """Texts to blocks: distinct words with their training counts and subwords, and every text as numbers of those."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(sent.value)
        for batch in batches:
            for part, data, at in slices(batch, "data", BLOCK_BYTES):
                low = LOWER[data]
                starts, ends = word_spans(low, at)
                edges = np.searchsorted(starts, at)
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                keys, first, index = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
                counts = np.bincount(index, weights=np.repeat(train, np.diff(edges)), minlength=len(keys)).astype(np.int64)
                size = ends[first] - starts[first] + 1
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                spelled = np.where(inner == 0, np.uint8(32), low[np.repeat(starts[first], size) + inner - (inner > 0)] if len(low) else 0).astype(np.uint8)
                tokens, lengths = coder.encode(spelled.tobytes(), len(keys)) if len(keys) else (np.zeros(0, np.int64),) * 2
                size = np.diff(np.concatenate([[0], np.cumsum(lengths[index])])[edges]) + 1
                ids = part.column("id")
                yield table_of(BLOCKS, [(
                    uuid.uuid4().int >> 65, int(train.sum()), int(windows_of(size)[train].sum()), ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), train.tobytes(),
                    np.diff(edges).tobytes(), index.astype(np.int32).tobytes(), keys.tobytes(), counts.tobytes(), tokens.astype(np.uint16).tobytes(), lengths.astype(np.int32).tobytes(),
                )]).to_batches()[0]

    return run


@dataclass(frozen=True)
class Block:
    """One row of the blocks table as arrays."""

    block: int
    ids: np.ndarray
    without_id: np.ndarray
    train: np.ndarray
    words: np.ndarray
    index: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray

    KINDS = {"ids": np.int64, "without_id": bool, "train": bool, "words": np.int64, "index": np.int32, "keys": np.uint64, "counts": np.int64, "tokens": np.uint16, "lengths": np.int32}

    @staticmethod
    def read(batch: pa.RecordBatch | pa.Table, row: int) -> Block:
        """Views of a row's columns: nothing is copied."""
        none, names = np.zeros(0), batch.schema.names
        return Block(batch.column("block")[row].as_py(), **{n: np.frombuffer(batch.column(n)[row].as_buffer(), t) if n in names else none for n, t in Block.KINDS.items()})

    def pieces(self, words: int = PIECE_WORDS) -> Iterator[Block]:
        """The block's texts in order, in blocks of at most ``words`` words or one text, with the same distinct words."""
        ends = np.cumsum(self.words)
        start = 0
        while start < len(ends):
            before = ends[start] - self.words[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + words, side="right")))
            yield replace(self, words=self.words[start:stop], index=self.index[before : ends[stop - 1]], train=self.train[start:stop])
            start = stop

    def stream(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(subword ids of all texts, each closed by ``end``; offsets of the texts)."""
        per_word = self.lengths[self.index]
        word_at = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        sums = np.zeros(len(per_word) + 1, dtype=np.int32)
        np.cumsum(per_word, out=sums[1:])
        at = np.concatenate([[0], sums[np.cumsum(self.words)] + np.arange(1, len(self.words) + 1)])
        place = np.repeat(word_at[self.index] - sums[:-1], per_word)
        place += np.arange(len(place), dtype=np.int32)
        out = np.full(int(at[-1]), end, dtype=np.int32)
        body = np.ones(len(out), dtype=bool)
        body[at[1:] - 1] = False
        out[body] = self.tokens[place]
        return out, at


# ---------------------------------------------------------------- word counts

ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TOLD = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("part_tokens", pa.int64()), ("part_words", pa.int64())])


def _ask_counts(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block.read(batch, row)
                rows = [(p, b.block, press_ascending(b.keys[w]), press(b.counts[w])) for p, w in split_keys(b.keys, parts)]
                if rows:
                    yield table_of(ASKED, rows).to_batches()[0]

    return run


def _tell_counts(table: pa.Table) -> pa.Table:
    keys, counts = open_ascending(table.column("keys")), open_pressed(table.column("counts"), np.int64)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    each = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
    part, seen = table.column("part")[0].as_py(), total > 0
    return table_of(TOLD, [(b, part, press(c), int(total.sum()), int(seen.sum())) for b, c in zip(table.column("block").to_pylist(), each, strict=True)])


SCORED = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64())])


def _base_scores(parts: int, tokens: int, words: int, trained: int):
    """Unigram scores of a block's texts from the counts of its words."""

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return SCORED.empty_table()
        b = Block.read(blocks, 0)
        c = np.zeros(len(b.keys), dtype=np.int64)
        answers = dict(zip(told.column("part").to_pylist(), open_pressed(told.column("counts"), np.int64), strict=True))
        for p, w in split_keys(b.keys, parts):
            c[w] = answers[p]
        text = np.repeat(np.arange(len(b.words)), b.words)
        whole = np.log10(tokens + words + 1.0)
        score = np.bincount(text, weights=(np.log10(c + 1.0) - whole)[b.index], minlength=len(b.words)) + np.log10(trained + 1.0) - whole
        known = np.bincount(text, weights=(c > 0)[b.index], minlength=len(b.words)).astype(np.int64) + (trained > 0)
        return pa.table([
            pa.array(np.full(len(text_ids := b.ids), b.block)), pa.array(np.arange(len(text_ids), dtype=np.int32)), pa.array(text_ids, mask=b.without_id), pa.array(~b.train), pa.array(b.words + 1), pa.array(known), pa.array(score),
        ], schema=SCORED)

    return run


# ---------------------------------------------------------------- the model

@dataclass
class Weights:
    """What gradient descent fits; ``last`` and ``before`` have one row for every subword."""

    last: np.ndarray
    before: np.ndarray
    place: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Weights:
        cuts = np.cumsum([a.size for a in self.arrays()])[:-1]
        return Weights(*(part.reshape(a.shape) for part, a in zip(np.split(flat, cuts), self.arrays(), strict=True)))


@dataclass(frozen=True)
class Shares:
    """Counted shares: by the slot before, the log share of each class and the log share of each slot in its class."""

    slot: np.ndarray
    token_share: np.ndarray
    class_of: np.ndarray
    log_class: np.ndarray
    log_in_class: np.ndarray
    end: int


def first_weights(shares: Shares, width: int = WIDTH, window: int = WINDOW, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    tokens, classes = len(shares.slot), shares.log_class.shape[1]
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Weights(
        draw(tokens, width), draw(tokens, width), draw(window, width), draw(width, width), draw(width, width), draw(width, width), draw(width, width),
        np.zeros((width, classes), np.float32), np.zeros(classes, np.float32))


def class_numbers(after: np.ndarray, counts: np.ndarray, classes: int, seed: int = 0) -> np.ndarray:
    """Slots grouped by what stands before them: k-means over a random projection of their predecessors' shares."""
    rng = np.random.default_rng(seed)
    before = after * counts[:, None]
    before = np.sqrt(before / np.maximum(before.sum(axis=0), 1e-12))
    points = (before.T @ rng.normal(size=(len(after), 32)).astype(np.float32)).astype(np.float32)
    weight = np.sqrt(counts + 1.0)
    centres = points[np.argsort(-counts, kind="stable")[:classes]].copy()
    number = np.zeros(len(points), dtype=np.int64)
    for _ in range(12):
        number = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)
        total = np.bincount(number, weights=weight, minlength=len(centres))
        for d in range(points.shape[1]):
            moved = np.bincount(number, weights=weight * points[:, d], minlength=len(centres))
            centres[:, d] = np.where(total > 0, moved / np.maximum(total, 1e-12), centres[:, d])
    _, number = np.unique(number, return_inverse=True)
    return number


def product(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``rows @ matrix`` over windows (n, length, width) in one product, whose rounding may depend on a row's place."""
    return (rows.reshape(-1, rows.shape[-1]) @ matrix).reshape(*rows.shape[:-1], matrix.shape[1])


def attention_maps(w: Weights) -> np.ndarray:
    """Query (scaled), key and value maps side by side, so that one product makes all three."""
    return np.concatenate([w.query * np.float32(1 / np.sqrt(w.query.shape[1])), w.key, w.value], axis=1)


def thirds(three: np.ndarray) -> list[np.ndarray]:
    """Views of the queries, keys and values that stand side by side."""
    return np.split(three, 3, axis=-1)


def forward(w: Weights, last: np.ndarray, before: np.ndarray, mask: np.ndarray, times: Callable = np.matmul) -> tuple[np.ndarray, ...]:
    """Batched masked attention over windows (n, length) of subword ids; (inputs, queries with keys and values, attention, mixed, state)."""
    x = w.last.take(last, axis=0)
    x += w.before.take(before, axis=0)
    x += w.place[: last.shape[1]]
    three = times(x, attention_maps(w))
    q, k, v = thirds(three)
    weight = q @ k.transpose(0, 2, 1)
    # a window with a score that might leave the range of exp is shifted row by row; the shares are the same either way
    flat = weight.reshape(len(weight), -1)
    far = np.flatnonzero(np.maximum(flat.max(axis=1), -flat.min(axis=1)) > SAFE_SCORE)
    weight += mask
    if len(far):
        weight[far] -= weight[far].max(axis=2, keepdims=True)
    np.exp(weight, out=weight)
    weight *= (1 / np.einsum("ijk->ij", weight))[:, :, None]
    mixed = weight @ v
    return x, three, weight, mixed, x + times(mixed, w.out)


def causal_mask(length: int) -> np.ndarray:
    return np.triu(np.full((length, length), -1e9, dtype=np.float32), 1)


def class_scores(w: Weights, scores: np.ndarray, log_class: np.ndarray) -> np.ndarray:
    """Logarithms of class probabilities but for a number per row, from rows of scores (states by ``w.classes``), in place."""
    scores += w.class_bias
    scores += log_class
    scores -= scores.max(axis=1, keepdims=True)
    return scores


def summed_rows(rows: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers, sums of the rows that share each)."""
    # numbers of 16 bits are sorted by radix
    order = np.argsort(number.astype(np.uint16) if number.max(initial=0) < 1 << 16 else number, kind="stable")
    held = number.take(order)
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return held.take(first), np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def _window_gradient(w: Weights, shares: Shares, ids: np.ndarray, target: np.ndarray, mask: np.ndarray, counted: np.ndarray, m: int) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss of some windows of a batch with ``m`` targets, its gradient for the small arrays and for each input."""
    last = ids[:, 1:-1]
    x, three, weight, mixed, state = forward(w, last, ids[:, :-2], mask, product)
    q, k, v = thirds(three)
    n, length, width = x.shape
    real = np.flatnonzero(((target >= 0) & counted).ravel())
    klass = shares.class_of.take(shares.slot.take(target.ravel().take(real)))
    flat = state.reshape(-1, width).take(real, axis=0)
    d_scores = class_scores(w, flat @ w.classes, shares.log_class.take(shares.slot.take(last.ravel().take(real)), axis=0))
    np.exp(d_scores, out=d_scores)
    d_scores *= (1 / np.einsum("ij->i", d_scores))[:, None]
    at = np.arange(len(real))
    loss = float(-np.log(d_scores[at, klass]).sum() / m)
    d_scores[at, klass] -= 1
    d_scores *= np.float32(1 / m)
    d_state = np.zeros((n * length, width), dtype=x.dtype)
    d_state[real] = d_scores @ w.classes.T
    d_state = d_state.reshape(n, length, width)
    d_mixed = product(d_state, w.out.T)
    d_weight = d_mixed @ v.transpose(0, 2, 1)
    d_weight -= np.einsum("ijk,ijk->ij", weight, d_weight)[:, :, None]
    d_weight *= weight
    d_three = np.empty_like(three)
    d_q, d_k, d_v = thirds(d_three)
    np.matmul(d_weight, k, out=d_q)
    np.matmul(d_weight.transpose(0, 2, 1), q, out=d_k)
    np.matmul(weight.transpose(0, 2, 1), d_mixed, out=d_v)
    d_x = d_state + product(d_three, attention_maps(w).T)
    outer = lambda a, b: a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])
    d_query, d_key, d_value = thirds(outer(x, d_three))
    small = {
        "place": np.vstack([d_x.sum(axis=0), np.zeros((len(w.place) - length, width), dtype=x.dtype)]), "query": d_query * np.float32(1 / np.sqrt(width)), "key": d_key, "value": d_value,
        "out": outer(mixed, d_state), "classes": flat.T @ d_scores, "class_bias": d_scores.sum(axis=0),
    }
    return loss, small, d_x.reshape(-1, width)


def touched_gradient(w: Weights, shares: Shares, window: np.ndarray, mask: np.ndarray, counted: np.ndarray | bool = True) -> tuple[float, dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Mean loss of the classes over windows (n, length + 2) of subword ids (two before, then the targets), and its gradient.

    The gradient comes whole for the small arrays and as (rows, gradients)
    for the embeddings, of which a batch touches few.  -1 is no target; where ``counted`` is
    false a subword is only read.  A batch is summed over parts of ``PART_WINDOWS`` windows, which stay in the processor's cache.
    """
    ids, target = np.maximum(window, 0), window[:, 2:]
    counted = np.broadcast_to(counted, target.shape)
    m = max(1, int(np.count_nonzero((target >= 0) & counted)))
    loss, small, rows = 0.0, {}, []
    for i in range(0, len(ids), PART_WINDOWS):
        part = slice(i, i + PART_WINDOWS)
        its_loss, its_small, its_rows = _window_gradient(w, shares, ids[part], target[part], mask, counted[part], m)
        loss += its_loss
        small = {name: small[name] + g for name, g in its_small.items()} if small else its_small
        rows.append(its_rows)
    rows = np.concatenate(rows)
    return loss, small, {"last": summed_rows(rows, ids[:, 1:-1].ravel()), "before": summed_rows(rows, ids[:, :-2].ravel())}


def gradient(w: Weights, shares: Shares, window: np.ndarray, mask: np.ndarray, counted: np.ndarray | bool = True) -> tuple[float, np.ndarray]:
    """As :func:`touched_gradient`, the gradient in one piece."""
    loss, small, touched = touched_gradient(w, shares, window, mask, counted)
    whole = dict(small)
    for name, (rows, values) in touched.items():
        whole[name] = np.zeros_like(getattr(w, name))
        whole[name][rows] = values
    return loss, np.concatenate([whole[f.name].ravel() for f in fields(w)]).astype(np.float32)


def descend(w: Weights, shares: Shares, windows: Iterable[tuple[np.ndarray, np.ndarray]], rate: float = 0.03) -> tuple[Weights, int]:
    """Adam over batches of windows, with the rate falling as one over the root of the steps; (weights, windows seen).

    Of the embeddings only the rows that a batch reads move, each corrected
    by how often it has moved.
    """
    w = w.filled(w.flat().astype(np.float32))
    mean, square = ({f.name: np.zeros_like(getattr(w, f.name)) for f in fields(w)} for _ in range(2))
    moved = {name: np.zeros(len(getattr(w, name)), dtype=np.int32) for name in ("last", "before")}
    step, seen = 0, 0
    mask = causal_mask(len(w.place))

    def change(g: np.ndarray, m: np.ndarray, s: np.ndarray, times: np.ndarray | int, pace: float) -> np.ndarray:
        m *= 0.9
        m += np.float32(0.1) * g
        s *= 0.99
        s += np.float32(0.01) * g * g
        return (pace * (m / (1 - 0.9**times)) / (np.sqrt(s / (1 - 0.99**times)) + 1e-8)).astype(np.float32)

    for window, counted in windows:
        _, small, touched = touched_gradient(w, shares, window, mask, counted)
        step += 1
        pace = rate / np.sqrt(1 + step / 100)
        for name, g in small.items():
            getattr(w, name)[...] -= change(g, mean[name], square[name], step, pace)
        for name, (rows, g) in touched.items():
            moved[name][rows] += 1
            m, s = mean[name].take(rows, axis=0), square[name].take(rows, axis=0)
            getattr(w, name)[rows] -= change(g, m, s, moved[name][rows, None].astype(np.float32), pace)
            mean[name][rows], square[name][rows] = m, s
        seen += len(window)
    return w, seen


def text_scores(w: Weights, shares: Shares, stream: np.ndarray, at: np.ndarray, step_windows: int = PART_WINDOWS) -> np.ndarray:
    """log10 probability of each text of a stream.

    Windows of ``WINDOW`` subwords overlap by ``OVERLAP``; a text's first window
    scores all its subwords, each later one those beyond the overlap, so every
    subword is scored once.
    """
    length = len(w.place)
    texts, size = len(at) - 1, np.diff(at)
    text, number, begin = window_places(at, length)
    previous = np.concatenate([stream[:1], stream[:-1]])
    second = np.concatenate([stream[:1], previous[:-1]])
    previous[at[:-1]] = shares.end
    second[at[:-1]] = shares.end
    second[np.minimum(at[:-1] + 1, len(second) - 1)[size > 1]] = shares.end
    out = np.zeros(texts)
    mask = causal_mask(length)
    for s in range(0, len(text), step_windows):
        part = slice(s, s + step_windows)
        place = begin[part, None] + np.arange(length)
        here = (place < at[1:][text[part], None]) & ((np.arange(length) >= OVERLAP) | (number[part, None] == 0))
        place = np.minimum(place, len(stream) - 1)
        last = previous.take(place)
        # One product per window, so that equal texts have equal scores wherever they stand in the block.
        scored = np.flatnonzero(here)
        scores = (forward(w, last, second.take(place), mask)[-1] @ w.classes).reshape(-1, w.classes.shape[1]).take(scored, axis=0)
        token, before_it = stream.take(place.ravel().take(scored)), shares.slot.take(last.ravel().take(scored))
        own = shares.slot.take(token)
        scores = class_scores(w, scores, shares.log_class.take(before_it, axis=0))
        value = scores[np.arange(len(own)), shares.class_of.take(own)] + shares.log_in_class[before_it, own] + shares.token_share.take(token)
        value -= np.log(np.einsum("ij->i", np.exp(scores, out=scores)))
        out += np.bincount(np.broadcast_to(text[part, None], here.shape).ravel().take(scored), weights=value, minlength=texts)
    return out / np.log(10.0)


# ---------------------------------------------------------------- counting and training on Spark

def count_shares(blocks: DataFrame, end: int, frequent: int = FREQUENT, classes: int = CLASSES) -> Shares:
    """Counts subwords, then pairs of the most frequent ones, over all training texts; at most ``frequent`` squared counts reach the driver."""

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block.read(batch, row)
                total += np.bincount(b.tokens, weights=np.repeat(b.counts, b.lengths), minlength=end + 1).astype(np.int64)
                total[end] += int(b.train.sum())
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["token", "n"])

    seen = blocks.select("block", "train", "counts", "tokens", "lengths").mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(end + 1, dtype=np.int64)
    for r in seen:
        total[r["token"]] = r["n"]
    ranked = np.argsort(-total, kind="stable")[:frequent]
    slot = np.full(end + 1, frequent, dtype=np.int32)
    slot[ranked] = np.arange(len(ranked))
    wide = frequent + 1

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(wide * wide, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for b in Block.read(batch, row).pieces():
                    stream, at = b.stream(end)
                    s = slot[stream]
                    pair = np.concatenate([slot[[end]], s[:-1]]) * np.int32(wide) + s
                    count += np.bincount(pair[np.repeat(b.train, np.diff(at))], minlength=wide * wide)
        hit = np.flatnonzero(count)
        for i in range(0, len(hit), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(hit[i : i + 500_000]), pa.array(count[hit[i : i + 500_000]])], names=["pair", "n"])

    table = blocks.select("block", "train", "words", "index", "tokens", "lengths").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(wide * wide, dtype=np.float32)
    count[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    count = count.reshape(wide, wide)
    of_slot = np.bincount(slot, weights=total, minlength=wide)
    smooth = (of_slot + 1) / (of_slot.sum() + wide)
    rows = count.sum(axis=1, keepdims=True)
    kinds = (count > 0).sum(axis=1, keepdims=True) + 1.0
    after = ((count + kinds * smooth) / (rows + kinds)).astype(np.float32)
    number = class_numbers(after, of_slot.astype(np.float32), classes)
    return shares_of(total, slot, of_slot, after, number, end)


def shares_of(total: np.ndarray, slot: np.ndarray, of_slot: np.ndarray, after: np.ndarray, number: np.ndarray, end: int) -> Shares:
    """Splits the smoothed shares ``after`` each slot into classes and shares of the class."""
    of_class = np.stack([after[:, number == c].sum(axis=1) for c in range(number.max() + 1)], axis=1)
    token_share = (total + 1.0) / np.bincount(slot, weights=total + 1.0, minlength=len(of_slot))[slot]
    return Shares(slot, np.log(token_share).astype(np.float32), number, np.log(of_class).astype(np.float32), np.log(after / of_class[:, number]).astype(np.float32), end)


def training_windows(block: Block, end: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of the windows that cover a block's training texts: subword ids with the two before each window, and which targets count.

    Windows overlap as in :func:`text_scores`; a subword counts in one of them.
    They come in a drawn order, so that a batch mixes texts.
    """
    stream, at = block.stream(end)
    text, number, begin = window_places(at, window)
    here = np.random.default_rng(len(stream)).permutation(np.flatnonzero(block.train[text]))
    for i in range(0, len(here), BATCH):
        n = here[i : i + BATCH]
        place = begin[n, None] + np.arange(-2, window)
        ids = stream[np.clip(place, 0, len(stream) - 1)]
        ids = np.where(place < at[:-1][text[n], None], end, np.where(place < at[1:][text[n], None], ids, -1))
        yield ids.astype(np.int32), (np.arange(window) >= OVERLAP) | (number[n, None] == 0)


def _averaged(table: pa.Table) -> pa.Table:
    """One piece of the weights of all trainers, averaged by the windows they saw."""
    seen = table.column("n").to_numpy()
    total = 0.0
    for piece, n in zip(table.column("weights"), seen, strict=True):
        total = total + np.frombuffer(piece.as_py(), np.float32).astype(np.float64) * n
    mean = (total / seen.sum()).astype(np.float32)
    return pa.table([pa.array([table.column("piece")[0].as_py()], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["piece", "weights"])


def train_weights(blocks: DataFrame, shares: Shares, rounds: int = ROUNDS, window: int = WINDOW) -> Weights:
    """Rounds of gradient descent: each trainer goes once over all windows of its blocks, then weights are averaged by windows seen.

    Windows are cut from the blocks table as they are used.  Trainers follow
    the table's files, with ``TRAINER_WINDOWS`` windows each at least.  Each
    piece of the weights is averaged on the executors, so one set of weights reaches the driver however many
    trainers there are.
    """
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("windows").alias("n")).first()["n"] or 0
    weights = first_weights(shares, window=window)
    if not total:
        return weights
    dealt = blocks.where("windows > 0").select("block", "train", "words", "index", "tokens", "lengths").coalesce(max(1, min(total // TRAINER_WINDOWS, len(blocks.inputFiles()))))
    fixed = spark.sparkContext.broadcast(shares)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def work(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            steps = (step for batch in batches for row in range(batch.num_rows) for step in training_windows(Block.read(batch, row), fixed.value.end, window))
            fitted, seen = descend(sent.value, fixed.value, steps)
            if seen:
                flat = fitted.flat()
                pieces = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()), pa.array([seen] * len(pieces), pa.int64())], names=["piece", "weights", "n"])

        made = dealt.mapInArrow(work, "piece int, weights binary, n long").groupBy("piece").applyInArrow(_averaged, "piece int, weights binary")
        parts = {r["piece"]: np.frombuffer(r["weights"], np.float32) for r in made.collect()}
        weights = weights.filled(np.concatenate([parts[i] for i in range(len(parts))]))
    return weights


def score_texts(docs: DataFrame, ranks: bytes, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows for which ``held_out`` is false.  Words are runs of
    bytes other than ASCII white space, lower-cased (A-Z); every text ends with
    one more token.  ``base_score`` sums log10((c + 1) / (N + V + 1)) over the
    tokens, c being a token's count, N all and V the distinct training tokens;
    ``score`` is the model's log10 probability of the text's subwords and end.

    Null and empty texts have the end token only.  Without training rows all
    counts are 0 and the model stays at its first weights.  Rows keep their
    own scores even if they share an id; a null id passes.  An empty table
    gives an empty result.

    Texts are numbered block by block where they are read; blocks exchange
    counts of their distinct words, and everything later reads the blocks
    table in the shared folder.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(ranks)
    end = subwords(ranks).end
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("data"), F.coalesce(~held_out, F.lit(True)).alias("train"))
    blocks = cut_lineage(rows.mapInArrow(_make_blocks(sent), "block long, trained long, windows long, " + ", ".join(f"{f.name} binary" for f in list(BLOCKS)[3:])), "blocks", group_rows=1)
    told = cut_lineage(blocks.select("block", "keys", "counts").mapInArrow(_ask_counts(parts), "part int, block long, keys binary, counts binary")
                       .groupBy("part").applyInArrow(_tell_counts, "block long, part int, counts binary, part_tokens long, part_words long"), "counts")
    sums = told.groupBy("part").agg(F.first("part_tokens").alias("t"), F.first("part_words").alias("w")).agg(F.sum("t").alias("t"), F.sum("w").alias("w")).first()
    trained = blocks.agg(F.sum("trained").alias("n")).first()["n"] or 0
    tokens, words = (sums["t"] or 0) + trained, (sums["w"] or 0) + (trained > 0)
    shares = count_shares(blocks, end)
    weights = train_weights(blocks, shares)
    model = spark.sparkContext.broadcast((weights, shares))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block.read(batch, row)
                values = np.concatenate([np.zeros(0), *(text_scores(*model.value, *piece.stream(end)) for piece in b.pieces())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), b.block)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["block", "row", "score"])

    base = blocks.select("block", "ids", "without_id", "train", "words", "index", "keys").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _base_scores(parts, tokens, words, trained), "block long, row int, id long, held_out boolean, n_tokens long, n_known long, base_score double")
    scored = blocks.select("block", "words", "index", "tokens", "lengths").mapInArrow(score, "block long, row int, score double")
    return base.join(scored, ["block", "row"]).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
