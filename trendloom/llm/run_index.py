"""A run-length index over byte strings: run-compressed Burrows-Wheeler transform with sampled run ends.

The index keeps one entry per run of the transform (first row, symbol, the row
its first entry steps to, text positions of its first and last row) and the
text itself.  Matching statistics are streamed from the right end of each
pattern to the left, for all patterns at once: while the current row's symbol
is the pattern's next symbol the match grows by one step; otherwise it moves to
the nearer end, by common prefix, of the previous or the next run of that symbol.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of many strings in order, by prefix doubling.

    ``symbols`` holds the strings end to end, each closed by a 0; ``left[i]`` is
    the number of symbols from i to its string's end mark, that included.  End
    marks rank by their place, so no two suffixes are equal.
    """
    n = len(symbols)
    index = np.arange(n)

    def ahead(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(left > by)
        out[inside] = values[inside + by]
        return out

    width = 3 if symbols.max(initial=0) < 1 << 20 else 1
    key = symbols.astype(np.int64)
    if width == 3:
        key = (key << 41) | (ahead(symbols, 1) << 20) | ahead(symbols, 2)
    while True:
        order = np.argsort(key)
        step = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], step[1:] != step[:-1]]))
        if rank[order[-1]] == n or width >= longest:
            break
        key = rank * (n + 2) + ahead(rank, width)
        width *= 2
    return np.argsort(rank * n + index)


class RunIndex:
    """Index of strings over integer symbols from 1 on; ``starts`` are the strings' first positions, 0 closes each."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        n = len(symbols)
        self.text = symbols
        ends = np.append(starts[1:], n)
        lengths = ends - starts
        left = np.repeat(ends, lengths) - np.arange(n)
        order = suffix_order(symbols, left, int(lengths.max()))
        before = np.where(left[order] == np.repeat(lengths, lengths)[order], 0, symbols[order - 1])
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.first = np.flatnonzero(head)
        self.last = np.append(self.first[1:], n) - 1
        self.symbol = before[self.first]
        self.head_at, self.tail_at = order[self.first], order[self.last]
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        size = (self.last - self.first + 1)[self.by_symbol]
        self.steps_to = np.empty(len(self.first), dtype=np.int64)
        self.steps_to[self.by_symbol] = np.cumsum(size) - size
        self.sorted_runs = self.symbol[self.by_symbol] * len(self.first) + self.by_symbol
        self.runs = len(self.first)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most ``most``."""
        out = np.zeros(len(a), dtype=np.int64)
        todo = np.flatnonzero(most > 0)
        while len(todo):
            x, y = self.text[a[todo] + out[todo]], self.text[b[todo] + out[todo]]
            todo = todo[(x == y) & (x != 0)]
            out[todo] += 1
            todo = todo[out[todo] < most[todo]]
        return out

    def matching_statistics(self, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For every position of the patterns (laid end to end) the length of the longest match that begins there."""
        out = np.zeros(len(patterns), dtype=np.int64)
        row = np.zeros(len(starts), dtype=np.int64)
        at = np.full(len(starts), self.head_at[0], dtype=np.int64)
        size = np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        deepest = -lengths[order]
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            live = order[: np.searchsorted(deepest, -depth, side="right")]
            place = starts[live] + lengths[live] - depth
            symbol = patterns[place]
            run = np.searchsorted(self.first, row[live], side="right") - 1
            same = self.symbol[run] == symbol
            grow = live[same]
            row[grow] = self.steps_to[run[same]] + row[grow] - self.first[run[same]]
            at[grow] -= 1
            size[grow] += 1
            jump, run, symbol = live[~same], run[~same], symbol[~same]
            if len(jump):
                to = np.searchsorted(self.sorted_runs, symbol * self.runs + run)
                following = self.by_symbol[np.minimum(to, self.runs - 1)]
                has_following = (to < self.runs) & (self.symbol[following] == symbol)
                previous = self.by_symbol[np.maximum(to - 1, 0)]
                has_previous = (to > 0) & (self.symbol[previous] == symbol)
                limit = size[jump]
                down = np.where(has_following, self.common(at[jump], self.head_at[following], np.where(has_following, limit, 0)), -1)
                up = np.where(has_previous, self.common(at[jump], self.tail_at[previous], np.where(has_previous, limit, 0)), -1)
                take_up = up > down
                found = has_following | has_previous
                chosen = np.where(take_up, previous, following)
                row_now = np.where(take_up, self.last[chosen], self.first[chosen])
                at_now = np.where(take_up, self.tail_at[chosen], self.head_at[chosen])
                row[jump] = np.where(found, self.steps_to[chosen] + row_now - self.first[chosen], 0)
                at[jump] = np.where(found, at_now - 1, self.head_at[0])
                size[jump] = np.where(found, np.maximum(up, down) + 1, 0)
            out[place] = size[live]
        return out
