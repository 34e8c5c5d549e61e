"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .components import connected_components
from .idfilter import IdFilter
from ..sources.scratch import Scratch

KEY_BITS = 52
KEY_MASK = B.U64((1 << KEY_BITS) - 1)
BITS = 1024
MOST_TEXTS = 1 << (64 - KEY_BITS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit shingle hashes of each of at most 4096 texts, and where each text's begin.

    Words are runs of bytes other than white space after lower-casing A-Z. A text of fewer than `size` words has its
    whole sequence as one shingle; one without words has none.
    """
    data = B.lower_ascii(data)
    starts, ends, before = B.words_of(data, offsets, ~B.SPACE)
    words = B.span_hashes(data, starts, ends)
    n = np.diff(before)
    count = np.where(n >= size, n - size + 1, 0)
    keys = [B.run_hashes(words, B.take_ranges(before[:-1], count), size)]
    texts = [np.repeat(np.arange(len(n)), count)]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        keys.append(B.run_hashes(words, before[short], k) ^ B.splitmix(np.full(len(short), k, B.U64)))
        texts.append(short)
    key = np.concatenate(texts).astype(B.U64) << B.U64(KEY_BITS) | np.concatenate(keys) >> B.U64(64 - KEY_BITS)
    key.sort()
    key = key[np.diff(key, prepend=~key[:1]) != 0] if len(key) else key
    at = np.searchsorted(key >> B.U64(KEY_BITS), np.arange(len(n) + 1))
    return key & KEY_MASK, at


def super_minhash(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures (texts x size, uint32) of sets given as elements and their bounds; empty sets are all ones.

    In step j an element draws a place from those it has not had (a lazily shuffled permutation) and the rank
    j + random fraction; a place keeps its least rank. The ranks of one element are so correlated that each step
    gives lower ranks than the next one, and a text is done once all its places hold ranks of past steps.
    """
    texts = len(at) - 1
    out = np.full((texts, size), 0xFFFFFFFF, np.uint32)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(texts), np.diff(at))
    seed = B.splitmix(keys)
    drawn: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for j in range(size):
            if not len(owner):
                break
            x = B.splitmix(seed + B.U64((j * 0xD1342543DE82EF95) % 2**64))
            place = (j + (x >> B.U64(32)) % B.U64(size - j)).astype(np.int16)
            rank = (x & B.U64(0xFFFFFF)).astype(np.uint32) | np.uint32(j << 24)
            drawn.append(place)
            own = place
            for i in range(j - 1, -1, -1):
                own = np.where(own == drawn[i], np.int16(i), own)
            np.minimum.at(flat, owner * size + own, rank)
            active = np.zeros(texts, bool)
            live = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
            active[live] = out[live].max(axis=1) >= (j + 1) << 24
            keep = active[owner]
            if not keep.all():
                owner, seed, drawn = owner[keep], seed[keep], [d[keep] for d in drawn]
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = signatures.reshape(len(signatures), bands, -1).astype(B.U64)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(B.splitmix(np.arange(bands, dtype=B.U64)), parts.shape[:2]).copy()
        for k in range(parts.shape[2]):
            h = B.splitmix(h * B.U64(3) + parts[:, :, k])
    return h.view(np.int64)


def bitmaps(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A bitmap of BITS bits of each set: a bit that one set has and another has not stands for a member it lacks."""
    texts = len(at) - 1
    bit = keys % B.U64(BITS)
    cell = np.repeat(np.arange(texts), np.diff(at)) * (BITS // 64) + (bit >> B.U64(6)).astype(np.int64)
    out = np.zeros(texts * (BITS // 64), B.U64)
    np.bitwise_or.at(out, cell, B.U64(1) << (bit & B.U64(63)))
    return out.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in B.pieces_of(batch, "text"):
            for k in range(0, len(part), MOST_TEXTS):
                yield part.slice(k, MOST_TEXTS)


def signatures(docs: DataFrame, size: int = 5, hashes: int = 128, bands: int = 32) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, bits): set_a and set_b are equal for equal sets."""

    def run(batches):
        for part in _runs(batches):
            keys, at = shingle_sets(*B.texts_of(part.column("text")), size)
            n = np.diff(at)
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                with np.errstate(over="ignore"):
                    total = np.concatenate([[B.U64(0)], np.cumsum(B.splitmix(keys ^ B.U64(salt)), dtype=B.U64)])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            keyed = band_keys(super_minhash(keys, at, hashes), bands)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keyed.reshape(-1)))
            ends = pa.array(np.arange(len(n) + 1) * (BITS // 64), pa.int32())
            bits = pa.ListArray.from_arrays(ends, pa.array(bitmaps(keys, at)))
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), listed, bits]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, members) of the documents named in ids: the full set as sorted 8-byte words.

    The scan itself leaves out what a bitmap of the ids rules out, so that no text is shuffled.
    """
    chosen = IdFilter(ids, "doc_id")

    def run(batches):
        for batch in batches:
            rows = np.flatnonzero(chosen_may(bitmap.value, batch.column("place").to_numpy()))
            for part in _runs([batch.take(pa.array(rows))] if len(rows) else []):
                keys, at = shingle_sets(*B.texts_of(part.column("text")), size)
                blob = keys.astype("<u8").tobytes()
                members = pa.array([blob[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), members], ["doc_id", "members"])

    bitmap, chosen_may = chosen.bitmap, IdFilter.may
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = source.withColumn("place", chosen.place("doc_id")).mapInArrow(run, "doc_id long, members binary")
    return sets.join(ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, part: int, whole: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) with whole * |intersection| >= part * |union| on full sets."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = scratch.write(_full_sets(docs, ids, size).dropDuplicates(["doc_id"]))

    def run(batches):
        for batch in batches:
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([p, q])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[k] = whole * shared >= part * (len(both) - shared)
            rows = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])

    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    with_both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a")
    return with_both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, part: int = 75, whole: int = 100, size: int = 5, hashes: int = 128, bands: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked at Jaccard similarity part / whole or more.

    Equal sets are one class, represented by its smallest doc_id; only representatives are banded. In each bucket all
    are first compared, on full sets, with its centre, the member that shares most buckets with others: rows in
    proportion to the bucket, and nearly all links of a group of near copies. What these links leave apart is then
    compared pair by pair, between different components of a bucket only, within the lengths that the similarity
    allows and where an exact bound on the intersection, from bitmaps of both sets, still allows it. No candidate of a
    bucket is left out otherwise. With 32 bands of 4 a pair at similarity 0.75 shares no bucket with a probability of
    5e-6; closer pairs much less.

    Null or empty texts have no shingles and link with nothing. Ties go to the smallest doc_id. Repeated rows are
    returned each, with equal values. A null doc_id is no representative; its component is its class's, or null. An
    empty table gives no rows; extra columns are ignored. Long texts are processed whole.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.write(signatures(docs, size, hashes, bands))
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = scratch.write(classes.where("rep is not null"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    buckets = scratch.write(reps.select("doc_id", "n_shingles", F.explode("bands").alias("key")))
    sizes = scratch.write(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = scratch.write(buckets.join(sizes, "key"))
    central = shared.groupBy("doc_id").agg(F.sum("n").alias("rank"))
    ranked = scratch.write(shared.drop("n").join(central, "doc_id"))
    centre = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("doc_id")).alias("a"), "n_shingles")).alias("c"))
    centre = scratch.write(centre.select("key", (-F.col("c.a")).alias("a"), F.col("c.n_shingles").alias("m")))

    def fits(m, n):
        return (F.lit(whole) * F.least(m, n)) >= (F.lit(part) * F.greatest(m, n))

    pairs = ranked.join(centre, "key").where((F.col("doc_id") != F.col("a")) & fits(F.col("m"), F.col("n_shingles")))
    pairs = pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    links = scratch.write(_confirmed(scratch.write(pairs), docs, size, part, whole, scratch))
    parts = scratch.write(connected_components(links, scratch))

    placed = ranked.select("key", "doc_id").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    placed = scratch.write(placed.withColumn("component", F.coalesce("component", "doc_id")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = scratch.write(mixed.where("low < high").select("key"))
    left = placed.join(mixed, "key", "left_semi")
    left = scratch.write(left.join(signed.select("doc_id", "n_shingles", "bits").dropDuplicates(["doc_id"]), "doc_id"))
    right = left.select("key", *[F.col(c).alias(f"other_{c}") for c in ("doc_id", "n_shingles", "bits", "component")])

    def lacking(mine, other):
        return f"aggregate(zip_with({mine}, {other}, (x, y) -> bit_count(x & ~y)), 0, (s, v) -> s + v)"

    both = F.least(
        F.col("n_shingles") - F.expr(lacking("bits", "other_bits")), F.col("other_n_shingles") - F.expr(lacking("other_bits", "bits"))
    )
    total = F.col("n_shingles") + F.col("other_n_shingles")
    may = F.lit(whole + part) * both >= F.lit(part) * total
    apart = F.col("component") < F.col("other_component")
    rest = left.join(right, "key").where(apart & fits(F.col("n_shingles"), F.col("other_n_shingles")) & may)
    rest = rest.select(F.least("doc_id", "other_doc_id").alias("a"), F.greatest("doc_id", "other_doc_id").alias("b"))
    rest = scratch.write(rest.distinct())
    if rest.limit(1).count():
        more = scratch.write(_confirmed(rest, docs, size, part, whole, scratch))
        if more.limit(1).count():
            parts = connected_components(links.union(more), scratch)
    named = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    named = scratch.write(named.select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    out = full.join(named, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that near_duplicates keeps, one row for each doc_id; those of null doc_id all stay."""
    found = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.where("doc_id is null"))
