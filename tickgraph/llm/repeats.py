"""Repeated passages: bytes covered by a string of a given length that begins at two or more places of the corpus."""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .idfilter import IdFilter
from .runindex import RunIndex
from ..sources.scratch import Scratch

#: Bytes that an anchor is chosen by.
SEED = 32
#: Bytes of text that a scan works on at once, whole texts at least.
RUN_BYTES = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the leftmost least seed of each string of `length` bytes: equal strings share theirs."""
    n = len(data)
    if n < length or not (np.diff(offsets) >= length).any():
        return np.zeros(0, np.int64), np.zeros(0, B.U64)
    seeds = B.rolling_hashes(data, SEED)
    order = seeds & B.U64(0xFFFFFFFF00000000)
    order |= np.arange(len(seeds), dtype=np.uint64)
    least = (_sliding_min(order, length - SEED + 1) & B.U64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, np.int64)
    whole = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[whole], 1)
    np.add.at(valid, offsets[whole + 1] - length + 1, -1)
    mark = np.zeros(n, bool)
    mark[least[np.cumsum(valid)[: len(least)] > 0]] = True
    places = np.flatnonzero(mark)
    return places, seeds[places]


def _anchor_rows(source: DataFrame, length: int) -> DataFrame:
    """(a, t, pos): each anchor's hash, text and place."""

    def run(batches):
        for batch in batches:
            for part in B.pieces_of(batch, "text", RUN_BYTES):
                data, offsets = B.texts_of(part.column("text"))
                places, seeds = anchors(data, offsets, length)
                text = np.searchsorted(offsets, places, side="right") - 1
                columns = [pa.array(seeds.view(np.int64)), part.column("t").take(pa.array(text)), pa.array((places - offsets[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "t", "pos"])

    return source.mapInArrow(run, "a long, t long, pos int")


def _mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where a hash stands in a bitmap; the same in _placed as a column."""
    return (keys & B.U64(bits - 1)).astype(np.int64)


class HashFilter(IdFilter):
    """An id filter of values that are hashes already: their low bits are their places."""

    def place(self, column):
        return F.col(column).bitwiseAND(F.lit(self.bits - 1))


def _contexts(source: DataFrame, length: int, shared: HashFilter, wanted: HashFilter | None = None) -> DataFrame:
    """(a, c, t, pos, lead[, bytes]): what lies within reach of each anchor that may be shared.

    c is equal for equal contexts. With `wanted`, a filter of c, the bytes come too, once for each c and task.
    """
    reach = length - SEED
    bitmap, bits = shared.bitmap, shared.bits
    second, second_bits = (wanted.bitmap, wanted.bits) if wanted else (None, 0)

    def run(batches):
        given: set[int] = set()
        for batch in batches:
            for part in B.pieces_of(batch, "text", RUN_BYTES):
                data, offsets = B.texts_of(part.column("text"))
                places, seeds = anchors(data, offsets, length)
                keep = IdFilter.may(bitmap.value, _mixed(seeds, bits))
                places, seeds = places[keep], seeds[keep]
                text = np.searchsorted(offsets, places, side="right") - 1
                begin, end = offsets[text], offsets[text + 1]
                start, stop = np.maximum(places - reach, begin), np.minimum(places + length, end)
                lead = places - start
                c = B.splitmix(B.span_hashes(data, start, stop) ^ B.splitmix(seeds) ^ B.splitmix(lead.astype(np.uint64)))
                rows = np.arange(len(c))
                if second is not None:
                    _, first = np.unique(c, return_index=True)
                    rows = np.sort(first[IdFilter.may(second.value, _mixed(c[first], second_bits))])
                    rows = np.array([r for r in rows.tolist() if int(c[r]) not in given], np.int64)
                    given.update(c[rows].tolist())
                columns = [pa.array(seeds[rows].view(np.int64)), pa.array(c[rows].view(np.int64)), part.column("t").take(pa.array(text[rows]))]
                columns += [pa.array((places - begin)[rows].astype(np.int32)), pa.array(lead[rows].astype(np.int32))]
                columns.append(pa.array((stop - start)[rows].astype(np.int32)))
                names = ["a", "c", "t", "pos", "lead", "size"]
                if second is not None:
                    blob = data.tobytes()
                    columns.append(pa.array([blob[i:j] for i, j in zip(start[rows].tolist(), stop[rows].tolist(), strict=True)], pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "a long, c long, t long, pos int, lead int, size int" + ", bytes binary" * (wanted is not None)
    return source.mapInArrow(run, schema)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _neighbours(keys: np.ndarray, rows: list[bytes], width: int) -> np.ndarray:
    """The longest prefix that each row shares with another row of its key, from neighbours in sorted order."""
    n = len(rows)
    m = np.zeros((n, width), np.uint8)
    for k, r in enumerate(rows):
        m[k, : len(r)] = np.frombuffer(r, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255; 0 is the end
    order = np.lexsort((np.ascontiguousarray(m).view(f"S{width}").reshape(-1), keys))
    same = keys[order[1:]] == keys[order[:-1]]
    equal = (m[order[1:]] == m[order[:-1]]) & (m[order[1:]] > 0)
    common = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1)) * same
    out = np.zeros(n, np.int64)
    np.maximum.at(out, order[1:], common)
    np.maximum.at(out, order[:-1], common)
    return out


def indexed_marks(rows: list[tuple], length: int) -> list[tuple[int, list[int], list[int]]]:
    """(c, starts, ends) for contexts (a, c, t, pos, lead, bytes): repeated strings, by their bytes relative to the anchor.

    A repeated string holds the anchor in all its contexts, so a context is first cut to what it shares with another one
    of its anchor on either side; what is then shorter than a string is out, and what is then equal is repeated as it
    is. The others go into the run-length index; overlapping ones of one text are joined, so that each place of the
    corpus is indexed once.
    """
    seen: set[int] = set()
    rows = [r for r in rows if not (r[1] in seen or seen.add(r[1]))]
    if not rows:
        return []
    keys = np.array([r[0] for r in rows], np.int64)
    left = _neighbours(keys, [r[5][: r[4]][::-1] for r in rows], length)
    right = _neighbours(keys, [r[5][r[4] :] for r in rows], length)
    out, cut = [], {}
    for r, lo, hi in zip(rows, left.tolist(), right.tolist(), strict=True):
        if lo + hi >= length:
            cut.setdefault((r[0], lo, r[5][r[4] - lo : r[4] + hi]), []).append(r)
    lone = False
    parts: list[tuple] = []
    for (_, lo, content), own in cut.items():
        parts.append((own[0][2], own[0][3] - lo, content, own[0][1] if len(own) == 1 else None, lo))
        lone |= len(own) == 1
        if len(own) > 1:
            out += [(r[1], [-lo], [len(content) - lo]) for r in own]
    if not lone:
        return out
    parts.sort(key=lambda p: p[:2])
    segments: list[bytearray] = []
    base: list[tuple[int, int]] = []
    for _, group in groupby(parts, key=lambda p: p[0]):
        begin = end = None
        for _, start, content, _, _ in group:
            if end is None or start > end:
                segments.append(bytearray())
                begin = end = start
            base.append((len(segments) - 1, start - begin))
            segments[-1] += content[end - start :]
            end = max(end, start + len(content))
    index = RunIndex([bytes(s) for s in segments], length)
    found = index.matches()
    for (segment, at), (_, _, content, c, lead) in zip(base, parts, strict=True):
        if c is not None:
            at += int(index.starts[segment])
            hit = found[at : at + len(content) - length + 1]
            if hit.any():
                lo, hi = _spans(hit)
                out.append((c, (lo - lead).tolist(), (hi - 1 + length - lead).tolist()))
    return out


MARKS = "c long, starts array<int>, ends array<int>"


def _marks(source: DataFrame, classes: DataFrame, length: int, shared: HashFilter, most_bytes: int, most_in_anchor: int, scratch: Scratch) -> DataFrame:
    """(c, starts, ends) for the contexts that hold repeated strings."""
    sizes = scratch.write(classes.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"))
    known = classes.where("many").select("c", F.array((-F.col("lead")).cast("int")).alias("starts"), F.array((F.col("size") - F.col("lead")).cast("int")).alias("ends"))
    among = scratch.write(classes.join(sizes.select("a"), "a", "left_semi").select("c"))
    contexts = _contexts(source, length, shared, HashFilter(among, "c"))
    crowds = scratch.write(sizes.where(F.col("n") > most_in_anchor).select("a"))
    crowded = crowds.limit(1).count() > 0
    if crowded:
        contexts = scratch.write(contexts)
        many = contexts.join(crowds, "a", "left_semi").groupBy("c").agg(F.first(F.struct("a", "lead", "bytes")).alias("x")).select("c", "x.*")
        many = scratch.write(many)
        contexts = contexts.join(crowds, "a", "left_anti")

    def index(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            found = indexed_marks(held, length)
            arrays = [pa.array([f[0] for f in found], pa.int64())] + [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (1, 2)]
            return pa.RecordBatch.from_arrays(arrays, ["c", "starts", "ends"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("a", "c", "t", "pos", "lead", "bytes")), strict=True):
                if size > most_bytes and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    def windows(batches):
        for batch in batches:
            for c, a, content in zip(*(batch.column(k).to_pylist() for k in ("c", "a", "bytes")), strict=True):
                data = np.frombuffer(content, np.uint8)
                at = np.arange(len(data) - length + 1)
                h = B.span_hashes(data, at, at + length) ^ B.splitmix(np.array([a], np.int64).view(np.uint64))
                columns_ = [pa.array(h.view(np.int64)), pa.array(np.full(len(at), c)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns_, ["w", "c", "at"])

    dealt = contexts.select("a", "c", "t", "pos", "lead", "bytes").repartition("a").sortWithinPartitions("a", "c")
    marked = known.unionByName(dealt.mapInArrow(index, MARKS))
    if not crowded:
        return scratch.write(marked)
    each = many.select("c", "a", "bytes").mapInArrow(windows, "w long, c long, at int")
    each = each.join(many.select("c", "lead"), "c").select("w", "c", (F.col("at") - F.col("lead")).alias("at"))
    common = each.groupBy("w", "at").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y")
    common = scratch.write(common.select("w", "at"))
    repeated = each.join(common, ["w", "at"], "left_semi").groupBy("c").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    repeated = repeated.select("c", "starts", F.transform("starts", lambda s: s + length).alias("ends"))
    return scratch.write(marked.unionByName(repeated))


def _chosen(source: DataFrame, chosen: HashFilter) -> DataFrame:
    """The texts whose hash may be among the chosen ones, so that the others are not shuffled."""
    bitmap, bits = chosen.bitmap, chosen.bits

    def run(batches):
        for batch in batches:
            places = batch.column("t").to_numpy().view(np.uint64)
            yield batch.take(pa.array(np.flatnonzero(IdFilter.may(bitmap.value, _mixed(places, bits)))))

    return source.mapInArrow(run, "t long, text string")


def _removed(joined: DataFrame) -> DataFrame:
    """(t, n_removed, kept_sha256, starts, ends): the repeated spans of a text, merged where they overlap or touch."""

    def run(batches):
        for batch in batches:
            for part in B.pieces_of(batch, "text"):
                data, offsets = B.texts_of(part.column("text"))
                listed = part.column("marks")
                flat = listed.flatten()
                text_of = np.repeat(np.arange(len(part)), np.diff(listed.offsets.to_numpy()))
                from_ = pc.struct_field(flat, "pos").to_numpy() + offsets[text_of] + text_of  # one place more for each text
                depth = np.zeros(len(data) + len(part) + 1, np.int64)
                for side, by in (("starts", 1), ("ends", -1)):
                    inner = pc.struct_field(flat, side)
                    at = np.repeat(from_, np.diff(inner.offsets.to_numpy())) + inner.flatten().to_numpy()
                    depth += by * np.bincount(at, minlength=len(depth))
                covered = np.cumsum(depth) > 0
                rows: list[tuple] = []
                for d in range(len(part)):
                    text = data[offsets[d] : offsets[d + 1]]
                    gone = covered[offsets[d] + d : offsets[d + 1] + d]
                    lo, hi = _spans(gone)
                    rows.append((int(gone.sum()), hashlib.sha256(text[~gone].tobytes()).hexdigest(), lo.tolist(), hi.tolist()))
                cols = list(zip(*rows, strict=True))
                arrays = [part.column("t"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["t", "n_removed", "kept_sha256", "starts", "ends"])

    return joined.mapInArrow(run, "t long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>")


def repeated_passages(docs: DataFrame, length: int = 200, most_bytes: int = 3 << 20, most_in_anchor: int = 60_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of each document.

    Removed is each UTF-8 byte covered by a string of `length` bytes that begins at two or more places of the corpus,
    in one document or in several; strings are judged on the input and never cross documents.

    Copies of a whole text are one text (all of it is repeated). Each string has an anchor, its leftmost least seed of
    32 bytes, so only what lies within reach of an anchor that occurs twice is looked at; a bitmap of such anchors, of
    bounded size, tells the scan which. Contexts that occur at two places are repeated as they are. The others, anchor
    by anchor, are cut and go into run-length indexes (see indexed_marks, runindex) of about `most_bytes`, whose
    streamed matching statistics mark the repeated strings. An anchor with more than `most_in_anchor` different
    contexts is no task's group: the hashes of its strings are counted over all executors instead.

    Null text counts as empty; texts shorter than `length` lose nothing. Repeated rows are copies. Null ids stay. An
    empty table gives no rows; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select("doc_id", text.alias("text")).withColumn("t", F.xxhash64("text"))
    facts = source.select("doc_id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256"))
    texts = scratch.write(facts.where(F.col("n_bytes") >= length).groupBy("t").agg(F.count("*").alias("copies")))
    texts_only = source.select("t", "text")
    rows = _anchor_rows(texts_only, length)
    place = F.xxhash64("t", "pos")
    twice = scratch.write(rows.groupBy("a").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("a"))
    shared = HashFilter(twice, "a")
    found = scratch.write(_contexts(texts_only, length, shared).select("a", "c", "t", "pos", "lead", "size"))
    classes = found.withColumn("u", F.xxhash64("t", "pos")).groupBy("a", "c").agg(F.min("u").alias("u"), F.max("u").alias("v"), F.min("lead").alias("lead"), F.min("size").alias("size"))
    classes = scratch.write(classes.select("a", "c", "lead", "size", (F.col("u") != F.col("v")).alias("many")))
    marks = _marks(texts_only, classes, length, shared, most_bytes, most_in_anchor, scratch)
    once = marks.groupBy("c").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    found = found.select("c", "t", "pos").join(scratch.write(once), "c")
    found = scratch.write(found.groupBy("t").agg(F.collect_set(F.struct("pos", "starts", "ends")).alias("marks")))
    alone = texts.where("copies = 1").select("t")
    single = scratch.write(found.join(alone, "t", "left_semi"))
    spans = scratch.write(_removed(_chosen(texts_only, HashFilter(single, "t")).join(single, "t")))
    copied = texts.where("copies > 1").select("t", F.lit(True).alias("copied"))
    result = scratch.write(spans.join(copied, "t", "full_outer"))
    out = facts.join(result, "t", "left")
    copied = F.coalesce("copied", F.lit(False))
    none = F.array().cast("array<long>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.greatest(F.size("starts"), F.lit(0)).cast("long")).alias("n_spans"),
        F.when(copied, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
        F.when(copied, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(copied, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
    )
