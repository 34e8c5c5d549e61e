"""Benchmark decontamination: a prefix-filtered containment join of benchmark windows with document words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from ..sources.scratch import Scratch

RESULT = "n_words long, n_hit long, item_ids array<bigint>, hit_spans array<struct<start:bigint,end:bigint>>"


def carried(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row, text): the carried columns as one struct, so that no name clashes, and the text beside it."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("string").alias("_"))
    return docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))


def _word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = B.texts_of(column)
    data = B.lower_ascii(data)
    starts, ends, before = B.words_of(data, offsets, B.ALNUM)
    return B.span_hashes(data, starts, ends), before


class WindowIndex:
    """The windows of some benchmark items, found by the rarest word of each."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        hashes, before = _word_hashes(pa.array([t for _, t in items], pa.string()))
        sizes = np.diff(before)
        length = np.minimum(sizes, window)
        count = np.where(sizes > 0, sizes - length + 1, 0)
        self.words = np.unique(hashes)
        at = B.take_ranges(before[:-1], count)
        lengths, item = np.repeat(length, count), np.repeat(np.arange(len(items)), count)
        keys = np.zeros(len(at), B.U64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            keys[rows] = B.run_hashes(hashes, at[rows], int(n)) ^ B.splitmix(np.array([n], B.U64))
        self.keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.length = lengths[first]
        self._at, self._hashes = at[first], hashes
        pairs = np.unique(np.stack([inverse, item], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))
        self.items = np.array([i for i, _ in items], np.int64)[pairs[:, 1]] if len(items) else np.zeros(0, np.int64)

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """counts: of each of self.words in all documents. The prefix of a window that must be found whole is one word."""
        self.anchor = np.zeros(len(self.keys), np.int64)
        rank = counts[np.searchsorted(self.words, self._hashes)] if len(self._hashes) else np.zeros(0, np.int64)
        for n in np.unique(self.length):
            rows = np.flatnonzero(self.length == n)
            self.anchor[rows] = np.argmin(rank[self._at[rows, None] + np.arange(n)], axis=1)
        prefix = self._hashes[self._at + self.anchor] if len(self.keys) else np.zeros(0, B.U64)
        order = np.argsort(prefix, kind="stable")
        self.prefix, first = np.unique(prefix[order], return_index=True)
        self.by_prefix, self.prefix_at = order, np.append(first, len(order))

    def positions(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each hash its place in the sorted words, or -1. A table of 2 ** 16 bits rules most out at once."""
        if not len(words):
            return np.full(len(hashes), -1)
        seen = np.zeros(1 << 20, bool)
        seen[(words >> B.U64(44)).astype(np.int64)] = True
        rows = np.flatnonzero(seen[(hashes >> B.U64(44)).astype(np.int64)])
        place = np.searchsorted(words, hashes[rows])
        place[place == len(words)] = 0
        out = np.full(len(hashes), -1)
        good = words[place] == hashes[rows]
        out[rows[good]] = place[good]
        return out

    def matches(self, hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence of a window inside one text."""
        place = self.positions(self.prefix, hashes)
        hit = np.flatnonzero(place >= 0)
        of = place[hit]
        counts = self.prefix_at[of + 1] - self.prefix_at[of]
        window = self.by_prefix[B.take_ranges(self.prefix_at[of], counts)]
        word = np.repeat(hit, counts)
        start = word - self.anchor[window]
        text = np.searchsorted(before, word, side="right") - 1
        inside = (start >= before[text]) & (start + self.length[window] <= before[text + 1])
        start, window = start[inside], window[inside]
        good = np.zeros(len(start), bool)
        for n in np.unique(self.length[window]):
            rows = np.flatnonzero(self.length[window] == n)
            found = B.run_hashes(hashes, start[rows], int(n)) ^ B.splitmix(np.array([n], B.U64))
            good[rows] = found == self.keys[window[rows]]
        return start[good], window[good]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(index: WindowIndex, column) -> tuple[np.ndarray, list[list[int]], list[list[tuple[int, int]]]]:
    hashes, before = _word_hashes(column)
    start, window = index.matches(hashes, before)
    n = len(before) - 1
    items: list[list[int]] = [[] for _ in range(n)]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    text = np.searchsorted(before, start, side="right") - 1
    order = np.argsort(text, kind="stable")
    start, window, text = start[order], window[order], text[order]
    bounds = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        d = int(text[lo])
        own = np.unique(window[lo:hi])
        found = index.items[B.take_ranges(index.item_at[own], index.item_at[own + 1] - index.item_at[own])]
        items[d] = np.unique(found).tolist()
        s = start[lo:hi] - before[d]
        spans[d] = _merge(list(zip(s.tolist(), (s + index.length[window[lo:hi]]).tolist(), strict=True)))
    return np.diff(before), items, spans


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str] | None = None,
    window: int = 10,
    most_broadcast: int = 32 << 20,
) -> DataFrame:
    """Benchmark windows in documents: (row, n_words, n_hit, item_ids, hit_spans) for each document.

    row holds the carried columns (doc_id alone by default). A window is `window` consecutive words of an item, or all
    words of a shorter item; an occurrence is exact and contiguous in the words of one document. Prefix filter: as all
    words of a window are necessary, a prefix of one word suffices, and it is the one that is rarest in all documents,
    counted in a first pass. Its place bounds where the window can lie (positional and length filter), then the whole
    window is compared.

    The windows are broadcast when the benchmark's text has at most `most_broadcast` bytes; a larger benchmark is dealt
    into parts of that size and each part has a pass of its own, whose hits are merged by document.

    Nulls: a null text or one without words has n_words 0 and no hit; items of null text or id are left out. An empty
    benchmark or document table gives no hits or no rows. Repeated documents are judged alone. Extra columns are ignored
    unless carried. Texts are processed whole, in runs of about 2 MB.
    """
    carry = carry or ["doc_id"]
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most_broadcast) or 1
    source, context = carried(docs, carry), docs.sparkSession.sparkContext
    if parts > 1:  # rows are told apart by a number of their own, as equal ones may repeat
        numbered = Scratch(docs.sparkSession, "windows").write(source.withColumn("id", F.monotonically_increasing_id()))
        source = numbered.select(F.struct("id").alias("row"), "text")
    schema = f"row {source.schema['row'].dataType.simpleString()}, {RESULT}"
    outs = []
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        index = WindowIndex([(r[0], r[1]) for r in mine.collect()], window)
        words = context.broadcast(index.words)

        def count(batches, words=words, index=index.__class__):
            own = words.value
            sums = np.zeros(len(own), np.int64)
            for batch in batches:
                for piece in B.pieces_of(batch, "text"):
                    hashes, _ = _word_hashes(piece.column("text"))
                    place = index.positions(None, own, hashes)
                    sums += np.bincount(place[place >= 0], minlength=len(own))
            rows = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sums[rows], pa.int64())], ["k", "n"])

        counts = np.zeros(len(index.words), np.int64)
        for k, n in source.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
            counts[k] = n
        index.order_by_rarity(counts)
        shared = context.broadcast(index)

        def scan(batches, shared=shared):
            for batch in batches:
                for piece in B.pieces_of(batch, "text"):
                    n, found, spans = _scan(shared.value, piece.column("text"))
                    hit = [sum(b - a for a, b in s) for s in spans]
                    pairs = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                    columns = [piece.column("row"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.int64())), pairs]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_hit", "item_ids", "hit_spans"])

        outs.append(source.mapInArrow(scan, schema))
    if parts == 1:
        return outs[0]
    out = outs[0]
    for other in outs[1:]:
        out = out.unionByName(other)
    out = out.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("spans"),
    )
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(done, F.array(s)))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    out = out.withColumn("hit_spans", F.aggregate("spans", none, step))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.select(F.col("row.id").alias("id"), "n_words", hit.alias("n_hit"), "item_ids", "hit_spans")
    return numbered.select("id", "row").join(out, "id").drop("id")


def digest(hits: DataFrame) -> DataFrame:
    """One row per document with the digest of its items, sorted as strings."""
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return hits.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    hits = find_windows(docs, benchmark, carry=docs.columns, **options)
    return hits.where("n_hit = 0").select("row.*")


def sha256_of(items: list[int]) -> str:
    """What digest() gives for a list of items; for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
