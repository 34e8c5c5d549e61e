"""A run-length index of some texts: their Burrows-Wheeler transform in runs, with suffix samples at run ends."""

from __future__ import annotations

import numpy as np

from . import bytescan as B

_STEP = 7


class RunIndex:
    """Of segments of bytes, each with an end mark of its own that is less than any byte.

    runs() are the places in suffix order where the transform changes its letter; only there are suffix positions and
    common prefixes with the neighbours kept. matches() streams along the text: with the letter before it equal to its
    neighbour's, a suffix shares one byte less than the suffix one place to the left, so all other values follow.
    """

    def __init__(self, segments: list[bytes], depth: int):
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths
        self.size = int((lengths + 1).sum())
        self.depth = depth
        letters = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint64) + B.U64(1)
        letters[self.ends] = 0
        self.letters = letters
        self.segment = np.repeat(np.arange(len(segments)), lengths + 1)
        self.left = self.ends[self.segment] - np.arange(self.size)
        self.words = self._words()
        self._sort()
        self._compress()

    def _words(self) -> np.ndarray:
        """The next seven letters of each place in nine bits each, zero from an end mark on."""
        padded = np.concatenate([self.letters, np.zeros(_STEP, B.U64)])
        out = np.zeros(self.size, B.U64)
        for k in range(_STEP):
            out = out << B.U64(9) | np.where(self.left > k, padded[k : k + self.size], B.U64(0))
        return out

    def _sort(self) -> None:
        """Suffix order by doubling; only suffixes that are not yet alone are sorted again."""
        n = self.size
        order = np.argsort(self.words)
        sorted_ = self.words[order]
        slots = np.arange(n)
        rank = np.zeros(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.diff(sorted_, prepend=~sorted_[:1]) != 0, slots, 0))
        first = np.diff(sorted_, prepend=~sorted_[:1]) != 0
        tied = ~(first & np.append(first[1:], True))
        h = _STEP
        active, slots = order[tied], slots[tied]
        while len(active):
            inside = self.left[active] > h
            second = np.where(inside, rank[np.minimum(active + h, n - 1)] + len(self.starts), self.segment[active])
            key = rank[active].astype(np.uint64) << B.U64(32) | second.astype(np.uint64)
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            order[slots] = active
            first = np.diff(key, prepend=~key[:1]) != 0
            rank[active] = np.maximum.accumulate(np.where(first, slots, 0))
            tied = ~(first & np.append(first[1:], True))
            active, slots = active[tied], slots[tied]
            h *= 2
        self._order = order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal letters from a and from b on, never beyond an end mark."""
        out = np.minimum(self.left[a], self.left[b])
        rows = np.arange(len(a))
        k = 0
        while len(rows := rows[out[rows] > k]):
            x = self.words[a[rows] + k] ^ self.words[b[rows] + k]
            bad = x != 0
            high = np.zeros(int(bad.sum()), np.int64)
            y = x[bad]
            for bit in (32, 16, 8, 4, 2, 1):
                up = y >> B.U64(bit) != 0
                high += np.where(up, bit, 0)
                y = np.where(up, y >> B.U64(bit), y)
            same = (62 - high) // 9
            out[rows[bad]] = np.minimum(out[rows[bad]], k + same)
            rows = rows[~bad]
            k += _STEP
        return out

    def _compress(self) -> None:
        order = self._order
        before = self.letters[order - 1]
        change = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.run_starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        self.run_letters = before[self.run_starts]
        tail = np.flatnonzero(change)
        self.head_at, self.tail_at = order[tail + 1], order[tail]
        self.head_common = self._common(order[tail], order[tail + 1])
        self.lone_first, self.lone_last = order[0], order[-1]
        del self._order

    def _stream(self, at: np.ndarray, value: np.ndarray, lone: int) -> np.ndarray:
        seen = np.zeros(self.size, np.int64)
        kept = np.full(self.size, -1)
        kept[at], kept[lone] = value, 0
        where = np.flatnonzero(kept >= 0)
        seen[where] = where
        seen = np.maximum.accumulate(seen)
        return np.maximum(kept[seen] - (np.arange(self.size) - seen), 0)

    def matches(self) -> np.ndarray:
        """For each place whether the depth bytes from it, inside its segment, begin anywhere else as well."""
        before = self._stream(self.head_at, self.head_common, self.lone_first)
        after = self._stream(self.tail_at, self.head_common, self.lone_last)
        return (np.maximum(before, after) >= self.depth) & (self.left >= self.depth)
