"""Bidirectional FM-index over a delimited vocabulary, searched with one error.

The text is ``$w1$w2$..$wk$`` for sorted distinct words; ``$`` is the
smallest symbol.  The index keeps the Burrows-Wheeler transforms of the text
and of its reverse with rank tables, and a pattern as two synchronised
intervals of suffix ranks, so a pattern can grow to the left or to the
right.  Rows that begin with ``$`` are sorted by the word that follows:
the suffix rank of ``$w$`` is the word's own rank plus one, and no suffix
array is kept.

All steps work on arrays of patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

DELIMITER = "\0"
CHUNK_SYMBOLS = 1 << 16      # of the queries searched together


def suffix_ranks(text: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of the suffixes in ascending order (prefix doubling, which
    starts from as many symbols as fit a 64-bit key)."""
    n, width = len(text), 1
    while width < n and (symbols + 1) ** (width + 1) < 1 << 62:
        width += 1
    rank = np.zeros(n, np.int64)
    for d in range(width):
        rank *= symbols + 1
        rank[:n - d] += text[d:] + 1
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        key = rank * (n + 1)
        key[:max(0, n - width)] += rank[width:] + 1
        rank, width = key, 2 * width


class _Counts:
    """For each symbol how many marked positions come before a position."""

    def __init__(self, marks, symbols: int, n: int):
        self.words = n // 64 + 1
        bits = np.zeros((symbols, self.words), np.uint64)
        before = np.zeros((symbols, self.words), np.int32)
        row = np.zeros(self.words * 64, bool)
        for c in range(symbols):
            row[:n] = marks(c)
            bits[c] = np.packbits(row, bitorder="little").view(np.uint64)
            before[c, 1:] = np.cumsum(np.bitwise_count(bits[c, :-1]))
        self.bits, self.before = bits.ravel(), before.ravel()

    def __call__(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = c * self.words + (i >> 6)
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.bits[at] & mask).astype(np.int64)


class _Half:
    """One reading direction of the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        self.bwt = text[suffix_ranks(text, symbols) - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        self.rank = _Counts(lambda c: self.bwt == c, symbols, n)
        self.less = _Counts(lambda c: self.bwt < c, symbols, n)

    def extend(self, s: "Intervals", c: np.ndarray) -> "Intervals":
        """The patterns grown by ``c`` in this direction; empty ones go."""
        high = s.low + s.size
        low = self.rank(c, s.low)
        size = self.rank(c, high) - low
        some = np.flatnonzero(size)
        c, old = c[some], s.take(some)
        return Intervals(old.who, self.first[c] + low[some],
                         old.other + self.less(c, high[some]) - self.less(c, old.low), size[some])

    def grown_otherwise(self, s: "Intervals", not_c: np.ndarray, symbols: int) -> "Intervals":
        """All non-empty one-symbol growths but by ``not_c`` or the delimiter."""
        one = s.size == 1
        c = self.bwt[s.low]
        single = np.flatnonzero(one & (c != not_c) & (c != 0))
        parts = [self.extend(s.take(single), c[single])]
        many = np.flatnonzero(~one)
        if len(many):
            m = s.take(many)
            every = np.arange(1, symbols)[None, :]
            low = self.rank(every, m.low[:, None])
            size = self.rank(every, (m.low + m.size)[:, None]) - low
            i, j = np.nonzero((size > 0) & (every != not_c[many][:, None]))
            c, old = j + 1, m.take(i)
            parts.append(Intervals(old.who, self.first[c] + low[i, j],
                                   old.other + self.less(c, old.low + old.size) - self.less(c, old.low), size[i, j]))
        return Intervals.joined(parts)


class Intervals:
    """Patterns of queries ``who``: ``low`` and ``size`` of the suffix-rank
    interval in the direction of growth, ``other`` its start in the other."""

    def __init__(self, who, low, other, size):
        self.who, self.low, self.other, self.size = who, low, other, size

    def take(self, at: np.ndarray) -> "Intervals":
        return Intervals(self.who[at], self.low[at], self.other[at], self.size[at])

    def turned(self) -> "Intervals":
        return Intervals(self.who, self.other, self.low, self.size)

    @staticmethod
    def joined(parts: Sequence["Intervals"]) -> "Intervals":
        return Intervals(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("who", "low", "other", "size")))


class Vocabulary:
    """Index of sorted distinct words; ``further``: words to be searched whose
    symbols the indexed words may lack."""

    def __init__(self, words: Sequence[str], further: Sequence[str] = ()):
        text = _codes(DELIMITER + DELIMITER.join([*words, ""]))
        alphabet = np.unique(np.concatenate([text, _codes("".join(further))]))
        if not len(words):
            alphabet, text = np.unique(np.append(alphabet, 0)), np.zeros(1, np.uint32)
        self.alphabet, self.symbols, self.size = alphabet, len(alphabet), len(text)
        text = np.searchsorted(alphabet, text)
        self.text, self.starts = text, np.flatnonzero(text == 0)[:-1] + 1
        self.right, self.left = _Half(text[::-1], self.symbols), _Half(text, self.symbols)

    def near(self, words: Sequence[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``words``, rank of an indexed word) for each pair that
        differs by one inserted, deleted or replaced symbol, where

        * ``first_half``: the first half of the searched word is a prefix of
          the found one (matched exactly, then the error to its right);
        * else: the second half is a suffix and the first half no prefix.

        The first half has half of the length, rounded down.  Every pair is
        found by one of the two; none is returned twice."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        who, found = [], []
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            step = max(1, CHUNK_SYMBOLS // int(length))
            for a in range(0, len(same), step):
                some = same[a:a + step]
                q = np.searchsorted(self.alphabet, _codes("".join(words[i] for i in some))).reshape(len(some), -1)
                w, rank = self._one_error(q, first_half)
                if not first_half:
                    half = q.shape[1] // 2
                    at = self.starts[rank][:, None] + np.arange(half)
                    other = (self.text[at] != q[w, :half]).any(1)
                    w, rank = w[other], rank[other]
                who.append(some[w])
                found.append(rank)
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *who]), np.concatenate([empty, *found])

    def _one_error(self, q: np.ndarray, first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        m, length = q.shape
        half = length // 2
        front, back = [*range(half - 1, -1, -1)], [*range(half, length)]
        exact_cols, rest = (front, back) if first_half else (back, front)
        grow, onward = (self.left, self.right) if first_half else (self.right, self.left)
        s = Intervals(np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, self.size))
        for col in exact_cols:
            s = grow.extend(s, q[s.who, col])
        s = grow.extend(s, np.zeros(len(s.who), np.int64)).turned()
        erred = s.take(np.empty(0, np.int64))
        for t, col in enumerate(rest):
            c = q[s.who, col]
            # a surplus symbol equal to the next one is taken as standing after it,
            # and of equal symbols in a row the last is the missing one: each pair once
            other = onward.grown_otherwise(s, c, self.symbols)
            missing = s if t + 1 == len(rest) else s.take(np.flatnonzero(q[s.who, rest[t + 1]] != c))
            erred = Intervals.joined([erred, other])                  # surplus
            erred = onward.extend(erred, q[erred.who, col])
            erred = Intervals.joined([erred, other, missing])         # replaced, missing
            s = onward.extend(s, c)
        erred = Intervals.joined([erred, onward.grown_otherwise(s, np.full(len(s.who), -1), self.symbols)])
        end = onward.extend(erred, np.zeros(len(erred.who), np.int64))
        rank = (end.other if first_half else end.low) - 1
        word = rank >= 0        # the text's ends meet in the transform: an empty word would be found there
        return end.who[word], rank[word]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)
