"""A bidirectional FM-index over a delimited vocabulary, and searches with one error.

The text is every word behind a delimiter, read as a circle.  A pattern is a pair of equally
long suffix-rank intervals: of the text, which grows to the left, and of the reversed text,
which grows to the right; a step in either direction keeps the two in step.  All
functions work on arrays of patterns at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols between two stored counts.
BLOCK = 32
#: Patterns extended at a time.
_AT_ONCE = 1 << 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a circular text in sorted order (prefix doubling)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1) + np.roll(rank, -step)
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.zeros(n, dtype=np.int64)
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=new[1:])
        if new[-1] == n - 1 or step >= n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        step *= 2


class _Ranks:
    """The last column of the sorted rotations, with counts of smaller symbols at block starts."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        n = len(text)
        blocks = n // BLOCK + 1
        last = np.full(blocks * BLOCK, symbols, dtype=np.uint8 if symbols < 255 else np.uint32)
        last[:n] = text[suffix_order(text) - 1]
        self.last = last.reshape(blocks, BLOCK)
        cell = np.arange(blocks).repeat(BLOCK) * (symbols + 1) + last
        seen = np.bincount(cell, minlength=blocks * (symbols + 1)).reshape(blocks, symbols + 1)
        before = np.zeros((blocks, symbols + 2), dtype=np.int32)
        before[1:, 1:] = np.cumsum(np.cumsum(seen, axis=0)[:-1], axis=1)
        self.before = before

    def at(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first ``place`` entries are smaller than the symbol, and how many equal it."""
        block, offset = place // BLOCK, place % BLOCK
        part = self.last[block]
        inside = np.arange(BLOCK) < offset[:, None]
        mark = symbol[:, None].astype(part.dtype)
        smaller = self.before[block, symbol] + ((part < mark) & inside).sum(axis=1)
        equal = self.before[block, symbol + 1] - self.before[block, symbol] + ((part == mark) & inside).sum(axis=1)
        return smaller, equal


@dataclass
class Patterns:
    """Of each pattern: its query, first rank in either direction, number of occurrences, and next position."""

    query: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    at: np.ndarray

    def take(self, which: np.ndarray) -> Patterns:
        return Patterns(self.query[which], self.left[which], self.right[which], self.size[which], self.at[which])

    def moved(self, steps: int) -> Patterns:
        return Patterns(self.query, self.left, self.right, self.size, self.at + steps)

    @staticmethod
    def joined(parts: list[Patterns]) -> Patterns:
        return Patterns(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("query", "left", "right", "size", "at")))


@dataclass
class Sequences:
    """Symbols of all queries in a row; each sequence ends with the delimiter."""

    symbols: np.ndarray
    starts: np.ndarray

    def next(self, p: Patterns, ahead: int = 0) -> np.ndarray:
        return self.symbols[self.starts[p.query] + p.at + ahead]


class BidirectionalIndex:
    """Index of distinct words given as symbols 1 ... ``symbols - 1``; 0 is the delimiter.

    Where the words come in ascending order, the left rank of a whole delimited word is its number.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, symbols: int) -> None:
        starts = np.cumsum(lengths) - lengths
        text = np.insert(words, starts, 0)
        self.symbols, self.size = symbols, len(text)
        self.left, self.right = _Ranks(text, symbols), _Ranks(text[::-1], symbols)
        counts = np.bincount(text, minlength=symbols)
        self.first = np.cumsum(counts) - counts

    def start(self, queries: int) -> Patterns:
        """The empty pattern for every query."""
        zero = np.zeros(queries, dtype=np.int64)
        return Patterns(np.arange(queries), zero, zero.copy(), np.full(queries, self.size), zero.copy())

    def extend(self, p: Patterns, symbol: np.ndarray, leftward: bool) -> Patterns:
        """The patterns with one more symbol on one side, at the same position; those without occurrence go."""
        parts = []
        for a in range(0, max(len(symbol), 1), _AT_ONCE):
            part, s = p.take(slice(a, a + _AT_ONCE)), symbol[a : a + _AT_ONCE]
            ranks, grown, kept = (self.left, part.left, part.right) if leftward else (self.right, part.right, part.left)
            smaller, equal = ranks.at(s, grown)
            smaller_end, equal_end = ranks.at(s, grown + part.size)
            grown, kept = self.first[s] + equal, kept + smaller_end - smaller
            out = Patterns(part.query, *((grown, kept) if leftward else (kept, grown)), equal_end - equal, part.at)
            parts.append(out.take(out.size > 0))
        return Patterns.joined(parts)

    def children(self, p: Patterns, leftward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pattern and symbol of every way to go on by a symbol that occurs there, but the delimiter."""
        ranks, first = (self.left, p.left) if leftward else (self.right, p.right)
        small = p.size <= self.symbols
        which = np.flatnonzero(small)
        owner = np.repeat(which, p.size[which])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(p.size[which]) - p.size[which], p.size[which]) + first[owner]
        found = np.unique(owner * self.symbols + ranks.last.ravel()[place].astype(np.int64))
        wide = np.flatnonzero(~small)
        every = (wide[:, None] * self.symbols + np.arange(1, self.symbols)).ravel()
        owner, symbol = np.divmod(np.concatenate((found, every)), self.symbols)
        real = symbol > 0
        return owner[real], symbol[real]


def one_error(index: BidirectionalIndex, exact: Sequences, other: Sequences, queries: int, leftward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Query and left rank of every word that holds one half of the query and is one edit away.

    ``exact`` is the half that must be there, ``other`` the half with the error, both
    from the middle outwards; ``leftward`` says that the exact half is the left one.  Among
    equal results only the outermost edit is followed, so that every word is found once.
    """
    # The exact half, delimiter included.
    p, whole = index.start(queries), []
    while len(p.query):
        symbol = exact.next(p)
        p = index.extend(p.moved(1), symbol, leftward)
        done = exact.symbols[exact.starts[p.query] + p.at - 1] == 0
        whole.append(p.take(done))
        p = p.take(~done)
    clean = Patterns.joined([*whole, p])
    clean.at = np.zeros_like(clean.at)
    # The other half, without an error so far (clean) or with one (edited).
    none = clean.take(np.zeros(0, dtype=np.int64))
    edited, found = none, [none]
    while len(clean.query) or len(edited.query):
        ahead = index.extend(edited.moved(1), other.next(edited), not leftward)
        done = other.symbols[other.starts[ahead.query] + ahead.at - 1] == 0
        found.append(ahead.take(done))
        symbol = other.next(clean)
        inside = np.flatnonzero(symbol > 0)
        owner, child = index.children(clean, not leftward)
        differs = child != symbol[owner]
        owner, child = owner[differs], child[differs]
        grown = index.extend(clean.take(owner), child, not leftward)
        replaced = grown.take(other.next(grown) > 0).moved(1)
        dropped = clean.take(inside)
        dropped = dropped.take(other.next(dropped) != other.next(dropped, 1)).moved(1)
        edited = Patterns.joined([ahead.take(~done), grown, replaced, dropped])
        clean = index.extend(clean.take(inside).moved(1), symbol[inside], not leftward)
    end = Patterns.joined(found)
    return end.query, end.left
