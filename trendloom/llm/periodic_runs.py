"""Periodic runs in word sequences, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least twice
as long, that no neighbouring word extends.  Its periods are proposed in three ways:

- periods of at most ``SMALL`` directly, by comparing the words with themselves some places on;
- on the scale t = 2, 4, 8, ... for periods of 3 t to 6 t: a position belongs to the synchronising set
  when the least hash among the fragments of t words that begin in the t + 1 positions from it on is that
  of the first or the last.  Whether it does depends on its context of 2 t words alone, and every t
  consecutive positions hold one, so in a run some member of the set and the one a period later have equal
  contexts.  Contexts that have no period of t / 3 or less stand so far apart that only a few need
  comparing;
- contexts that have such a small period lie in runs already found on lower scales.  Two such
  regions with the same rotation of their period fix the larger period up to multiples of the small one,
  so pairs of neighbouring regions supply what the equal contexts leave out.

Every proposal is then compared word by word and extended to both sides, so hashes decide nothing but
what is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.textbytes import mix, slices
from trendloom.runtime import require

SMALL = 5
LEAST_LENGTH = 12
_U = np.uint64
_FACTOR = _U(0xD6E8FEB86659FD93)


class RunFinder:
    """Collects the runs of an integer sequence; proposals may come in any order and more than once."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period seen
        self.last: dict[int, tuple[int, int]] = {}  # by period: the stretch extended last

    def propose(self, at: int, period: int) -> None:
        """Extends the equality of words ``period`` apart around ``at`` and keeps the stretch if it holds two periods."""
        seen = self.last.get(period)
        if seen is not None and seen[0] <= at < seen[1]:
            return
        words, n = self.words, len(self.words)
        right, step = at, 64
        while right + period < n:
            size = min(step, n - period - right)
            unequal = words[right : right + size] != words[right + period : right + period + size]
            stop = int(unequal.argmax())
            if unequal[stop]:
                right += stop
                break
            right += size
            step *= 4
        left, step = at, 64
        while left > 0:
            size = min(step, left)
            unequal = (words[left - size : left] != words[left - size + period : left + period])[::-1]
            stop = int(unequal.argmax())
            if unequal[stop]:
                left -= stop
                break
            left -= size
            step *= 4
        self.last[period] = (left, max(right, at + 1))
        if right - left >= period:
            self.add(left, right + period, period)

    def add(self, start: int, end: int, period: int) -> None:
        known = self.runs.get((start, end))
        if known is None or period < known:
            self.runs[start, end] = period


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width``, by prefixes and suffixes of blocks as long."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    shaped = padded.reshape(blocks, width)
    before = np.minimum.accumulate(shaped, axis=1).ravel()
    after = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def synchronising_positions(fragments: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose context selects them; ``fragments`` holds the hash of the ``scale`` words from each position on."""
    if len(fragments) <= scale:
        return np.zeros(0, np.int64)
    least = _window_least(fragments, scale + 1)
    m = len(least)
    return np.flatnonzero((fragments[:m] == least) | (fragments[scale : scale + m] == least))


def least_rotation(words: list[int]) -> int:
    """Where the least rotation of a sequence begins."""
    n = len(words)
    i, j, k = 0, 1, 0
    while i < n and j < n and k < n:
        a, b = words[(i + k) % n], words[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    return min(i, j)


class _Regions:
    """Known runs as highly periodic regions of the scales above them, each with the least rotation of its period."""

    def __init__(self, finder: RunFinder) -> None:
        self.finder = finder
        self.rotations: dict[tuple[int, int], tuple[bytes, int]] = {}

    def of_scale(self, scale: int) -> list[tuple[int, int, int]]:
        """(start, end, period) of the runs of two contexts' fragments or more, with periods of at most a third of the scale."""
        return sorted((s, e, p) for (s, e), p in self.finder.runs.items() if 3 * p <= scale and e - s >= 2 * scale)

    def rotation(self, start: int, end: int, period: int) -> tuple[bytes, int]:
        """(the period's words from the least rotation on, where it begins as a remainder)."""
        found = self.rotations.get((start, end))
        if found is None:
            words = self.finder.words[start : start + period]
            turn = least_rotation(words.tolist())
            found = self.rotations[start, end] = (np.roll(words, -turn).tobytes(), (start + turn) % period)
        return found

    def propose(self, regions: list[tuple[int, int, int]], scale: int) -> None:
        """Periods of 3 to 6 scales that take a context in one region to a context in a later one."""
        alike: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for start, end, period in regions:
            root, phase = self.rotation(start, end, period)
            alike.setdefault((period, root), []).append((start, end, phase))
        for (period, _), group in alike.items():
            for i, (s1, e1, phase1) in enumerate(group):
                for s2, e2, phase2 in group[i + 1 :]:
                    if s2 - e1 >= 6 * scale:
                        break
                    low = max(3 * scale, s2 - (e1 - 2 * scale))
                    high = min(6 * scale - 1, (e2 - 2 * scale) - s1)
                    first = low + (phase2 - phase1 - low) % period
                    for q in range(first, high + 1, period):
                        self.finder.propose(max(s1, s2 - q), q)


def find_runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs of ``LEAST_LENGTH`` words and two periods or more, by start, then period.

    ``words`` numbers the words of several texts one after the other, each
    text followed by one number that occurs nowhere else; ``ends`` holds the
    places of those, so that no run crosses texts.
    """
    finder = RunFinder(words)
    for period in range(1, SMALL + 1):
        starts, stops = _stretches(words[period:] == words[:-period])
        long = stops - starts + period >= (8 if period == 1 else LEAST_LENGTH)  # runs of 8 equal words are regions of a scale, too
        for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            finder.add(s, e + period, period)
    regions = _Regions(finder)
    place = np.arange(len(words))
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    sizes = ends - first + 1
    with np.errstate(over="ignore"):
        fragments = mix(words.astype(np.uint64) * _FACTOR + _U(1))
        longer = mix(fragments[:-1] * _FACTOR + fragments[1:])
        scale = 2
        while True:
            # Texts too short for two periods of this scale leave; fragments across the joint hold a text's own end and stay without a partner.
            deep = sizes >= 6 * scale + 1
            if not deep.any():
                break
            if not deep.all():
                kept = np.repeat(deep, sizes)
                place = place[kept]
                longer = np.append(longer, np.zeros(len(kept) - len(longer), np.uint64))[kept]
                sizes = sizes[deep]
            fragments = longer
            context = mix(fragments[:-scale] * _FACTOR + fragments[scale:])
            _propose_equal_contexts(finder, regions, fragments, context, place, scale)
            longer = context
            scale *= 2
    found = sorted((s, p, e) for (s, e), p in finder.runs.items() if e - s >= max(LEAST_LENGTH, 2 * p))
    table = np.array(found, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 2], table[:, 1]


def _propose_equal_contexts(finder: RunFinder, regions: _Regions, fragments: np.ndarray, context: np.ndarray, place: np.ndarray, scale: int) -> None:
    chosen = synchronising_positions(fragments, scale)
    chosen = chosen[chosen < len(context)]
    order = np.argsort(context[chosen], kind="stable")
    keys = context[chosen][order]
    same = keys[1:] == keys[:-1]
    repeated = np.zeros(len(keys), dtype=bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    at, keys = place[chosen[order[repeated]]], keys[repeated]
    known = regions.of_scale(scale)
    if known:
        # Contexts inside a highly periodic region: their periods come from pairs of regions.
        cover = np.zeros(len(finder.words) + 1, dtype=np.int32)
        for start, end, _ in known:
            cover[start] += 1
            cover[end - 2 * scale + 1] -= 1
        free = np.cumsum(cover)[at] == 0
        at, keys = at[free], keys[free]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    ahead = 1
    while ahead < len(at):
        gap = at[ahead:] - at[:-ahead]
        near = (keys[ahead:] == keys[:-ahead]) & (gap < 6 * scale)
        if not near.any():
            break
        wanted = near & (gap >= 3 * scale)
        pairs.append((gap[wanted], at[:-ahead][wanted]))
        ahead += 1
    if pairs:
        gaps, starts = (np.concatenate(c) for c in zip(*pairs, strict=True))
        by_gap = np.lexsort((starts, gaps))
        for gap, start in zip(gaps[by_gap].tolist(), starts[by_gap].tolist(), strict=True):
            finder.propose(start, gap)
    if known:
        regions.propose(known, scale)


_RESULT = [
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))),
    ("collapsed", pa.binary()),
]
_DIGESTS = [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def _number_words(data: np.ndarray, at: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, their numbers with one end after each text, the places of the ends); equal bytes have equal numbers."""
    raw = data.tobytes()
    texts = [raw[s:e].split() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    ends = np.cumsum(sizes + 1) - 1
    words = np.empty(int(sizes.sum()) + len(texts), dtype=np.int64)
    inside = np.ones(len(words), dtype=bool)
    inside[ends] = False
    words[inside] = flat.indices.to_numpy(zero_copy_only=False)
    words[ends] = -1 - np.arange(len(texts))
    return texts, words, ends


def describe_texts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[list[int]], bytes]]:
    """For each text: (number of runs, its runs as [start, length, period] by start and period, the kept words joined by one space)."""
    texts, words, ends = _number_words(data, at)
    starts, stops, periods = find_runs(words, ends)
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(dropped, starts + periods, 1)
    np.add.at(dropped, stops, -1)
    gone = np.cumsum(dropped) > 0
    firsts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    from_run = np.searchsorted(starts, firsts)
    to_run = np.searchsorted(starts, ends)
    for text, first, a, b in zip(texts, firsts.tolist(), from_run.tolist(), to_run.tolist(), strict=True):
        if a == b:
            yield 0, [], b" ".join(text)
            continue
        runs = [[s - first, e - s, p] for s, e, p in zip(starts[a:b].tolist(), stops[a:b].tolist(), periods[a:b].tolist(), strict=True)]
        lost = gone[first : first + len(text)].tolist()
        yield b - a, runs, b" ".join(w for w, g in zip(text, lost, strict=True) if not g)


def mark_periodic_runs(docs: DataFrame, *, text_col: str = "text", digests: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the periodic runs of their whole texts.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  Adds ``n_runs``; of
    the longest run (ties: least start, then period) ``start``, ``length``,
    ``period`` and ``exponent_milli``, null without run; then ``runs``
    (array of [start, length, period] by start, then period) and
    ``collapsed``, the text without the words that any run holds after its
    first period, joined by one space.  With ``digests`` the last two are
    given as SHA-256: of a line ``start,length,period`` per run, and of the
    collapsed text.

    Null and empty texts have no runs and an empty collapsed text.  Rows do not
    touch each other: ties and repeated rows give equal results.  Texts are
    worked on in slices of a few megabytes, one longer text by itself.
    Existing columns of the names of the results are replaced, except the text.
    """
    fields = [*_RESULT[:5], *(_DIGESTS if digests else _RESULT[5:])]
    names = [n for n, _ in fields]
    require(text_col not in names, "the text needs a name that no result has")
    kept = docs.drop(*names)
    own = "__text"
    source = kept.withColumn(own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, own):
                rows: list[tuple] = []
                for count, runs, collapsed in describe_texts(data, at):
                    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
                    head = (count, *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
                    if digests:
                        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                        rows.append((*head, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
                    else:
                        rows.append((*head, runs, collapsed))
                columns = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != own]
                results = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*columns, *results], names=[*(n for n in part.schema.names if n != own), *names])

    kinds = {"runs": "array<array<bigint>>", "collapsed": "binary", "runs_sha256": "string", "collapsed_sha256": "string"}
    schema = kept
    for name in names:
        schema = schema.withColumn(name, F.lit(None).cast(kinds.get(name, "bigint")))
    out = source.mapInArrow(mark, schema.schema)
    return out if digests else out.withColumn("collapsed", F.col("collapsed").cast("string"))
