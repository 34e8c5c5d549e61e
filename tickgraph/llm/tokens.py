"""Token ids of whole texts: byte-level BPE by the tokenizers library, each distinct pre-token encoded once per worker."""

from __future__ import annotations

import unicodedata

import numpy as np

from . import bytescan as B

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points from here on go to the library as whole texts; below, the classes of letters and numbers are settled.
SETTLED = 0x500
_SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}


def _classes() -> np.ndarray:
    table = np.zeros(0x800, np.uint8)
    for cp in range(SETTLED):
        kind = unicodedata.category(chr(cp))[0]
        table[cp] = SPACE if cp in _SPACES else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return table


CLASSES = _classes()


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies use for each byte: itself where printable, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens begin, in texts whose code points are below SETTLED.

    The pieces are those of the byte-level pattern: the endings 's 't 're 've 'm 'll 'd; runs of letters, of numbers
    and of other characters, each with one blank before it; runs of space, of which the last character before a word
    is apart.
    """
    n = len(data)
    kind = CLASSES[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        own = CLASSES[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
        kind[lead] = kind[lead + 1] = own
    begins = np.zeros(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[offsets] = True
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    starts = begins.copy()
    word = np.flatnonzero(begins[:n] & (kind != SPACE) & ~text_start[:n])
    word = word[kind[word - 1] == SPACE]
    last = word - 1
    last = last - ((data[last] & 0xC0) == 0x80)
    starts[last] = True
    starts[word[data[word - 1] == 32]] = False
    quote = np.flatnonzero((data == 39) & starts[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        padded = np.append(data, [0, 0, 0])
        one = np.isin(padded[quote + 1], np.frombuffer(b"stmd", np.uint8))
        pair = padded[quote + 1].astype(np.int64) << 8 | padded[quote + 2]
        two = np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]) & ~text_start[np.minimum(quote + 2, n)]
        for mask, size in ((one, 2), (two & ~one, 3)):
            at = quote[mask]
            starts[at + 1] = False
            rest = at + size
            rest = rest[rest < n]
            rest = rest[(kind[rest] == LETTER) & ~text_start[rest]]
            starts[rest] = True
    return np.flatnonzero(starts[:n])


class _Table:
    """Sorted hashes of pre-tokens with their ids."""

    def __init__(self):
        self.keys, self.at, self.size = np.zeros(0, B.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys, at, size):
        order = np.argsort(joined := np.concatenate([self.keys, keys]))
        self.keys, self.at, self.size = joined[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def find(self, keys):
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        return place, (self.keys[place] == keys) if len(self.keys) else np.zeros(len(keys), bool)


class Encoder:
    """Ids of texts, equal to tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, most_kept: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_kept = most_kept
        self._clear()

    def _clear(self):
        self.old, self.new = _Table(), _Table()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        tokenize = self.model.tokenize
        found = [[x.id for x in tokenize(t.translate(BYTE_LETTERS))] for t in texts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.new.add(keys, self.used + np.cumsum(size) - size, size)
        self.used += total
        if len(self.new.keys) > 50_000 + len(self.old.keys) // 3:
            self.old.add(self.new.keys, self.new.at, self.new.size)
            self.new = _Table()

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, size, seen = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for table in (self.old, self.new):
            place, good = table.find(keys)
            at[good], size[good] = table.at[place[good]], table.size[place[good]]
            seen |= good
        return at, size, seen

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        plain = np.zeros(len(offsets) - 1, bool)
        odd = np.flatnonzero(data >= 0xC0 + (SETTLED >> 6))
        plain[np.searchsorted(offsets, odd, side="right") - 1] = True
        blob = data.tobytes()
        for mark in self.special:
            place = blob.find(mark)
            while place >= 0:
                plain[np.searchsorted(offsets, place, side="right") - 1] = True
                place = blob.find(mark, place + 1)
        if plain.any():
            return self._mixed(data, offsets, plain, blob)
        return self._fast(data, offsets, blob)

    def _mixed(self, data, offsets, plain, blob):
        parts: list[np.ndarray] = []
        start = 0
        edges = [*np.flatnonzero(np.diff(plain)) + 1, len(plain)]
        counts = np.zeros(len(plain), np.int64)
        for end in edges:
            lo, hi = offsets[start], offsets[end]
            if plain[start]:
                for d in range(start, end):
                    ids = self.tokenizer.encode(blob[offsets[d] : offsets[d + 1]].decode(), add_special_tokens=False).ids
                    counts[d] = len(ids)
                    parts.append(np.array(ids, np.uint32))
            else:
                ids, counts[start:end] = self._fast(data[lo:hi], offsets[start : end + 1] - lo, blob[lo:hi])
                parts.append(ids)
            start = end
        return np.concatenate(parts), counts

    def _fast(self, data, offsets, blob):
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if len(self.old.keys) + len(self.new.keys) > self.most_kept:
            self._clear()
        starts = pretoken_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = B.span_hashes(data, starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, size, seen = self._lookup(keys)
        if not seen.all():
            rows = first[~seen]
            self._learn(keys[~seen], [blob[a:b].decode("latin-1") for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)])
            at, size, _ = self._lookup(keys)
        counts = size[inverse]
        ids = self.ids[B.take_ranges(at[inverse], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
