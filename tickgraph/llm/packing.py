"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .decontaminate import carried
from ..sources.scratch import Scratch
from .tokens import encoder


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else full pieces of which the first may be shorter."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Each goes, in the order given, where sum over gaps g of n(g)^2 becomes smallest.

    n(g) counts open bins with gap g. Among equal sums an open bin goes before a new one, and the smallest gap first.
    """
    n = np.zeros(capacity + 1, np.int64)
    bins: dict[int, list[int]] = defaultdict(list)
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k, size in enumerate(lengths.tolist()):
        gaps = size + np.flatnonzero(n[size:capacity])
        best = None
        if len(gaps):
            left = gaps - size
            cost = np.where(left > 0, 2 * n[left] + 1, 0) - 2 * n[gaps] + 1
            j = int(np.argmin(cost))
            best, change = int(gaps[j]), int(cost[j])
        left = capacity - size
        if best is None or change > (2 * int(n[left]) + 1 if left else 0):
            b, gap, opened = opened, capacity, opened + 1
        else:
            gap = best
            b = bins[gap].pop()
            n[gap] -= 1
        which[k], offset[k] = b, capacity - gap
        left = gap - size
        if left:
            bins[left].append(b)
            n[left] += 1
    return which, offset


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, carry: list[str], end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(row, piece, start, length, ids_crc32[, ids]) of each piece of each document."""
    source = carried(docs, carry)
    schema = f"row {source.schema['row'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in B.pieces_of(batch, "text"):
                data, offsets = B.texts_of(part.column("text"))
                ids, counts = encode(data, offsets)
                ends = np.cumsum(counts)
                at, rows = [], []
                for d, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    own = np.append(ids[end - count : end], np.uint32(end_id)).astype("<u4")
                    for p, (start, length) in enumerate(cut(count + 1, capacity)):
                        piece = own[start : start + length]
                        at.append(d)
                        rows.append((p, start, length, zlib.crc32(piece), piece.astype(np.int32) if with_ids else None))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                arrays = [part.column("row").take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32())]
                arrays += [pa.array(c, pa.int64()) for c in columns[1:4]]
                names = ["row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(columns[4], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, schema)


def _pack_groups(items: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """Items (k, length) dealt by a hash into groups, each packed by itself, longest first."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "k"], ascending=[False, True], kind="stable")
        lengths = frame["length"].to_numpy()
        which, offset = sum_of_squares(lengths, capacity)
        filled = np.bincount(which, lengths)[which].astype(np.int64)
        number = (level << 62) | (frame["g"].to_numpy().astype(np.int64) << 32) | which
        return pd.DataFrame({"k": frame["k"], "length": lengths, "sequence_id": number, "offset": offset, "filled": filled})

    dealt = items.withColumn("g", F.pmod(F.xxhash64("k", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(pack, "k long, length long, sequence_id long, offset long, filled long")


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = 2048,
    carry: list[str] | None = None,
    group_size: int = 20_000,
    well_filled: float = 0.98,
    with_ids: bool = False,
) -> DataFrame:
    """Documents as token pieces in sequences of at most `capacity`: (row, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and then id 0; only longer ones are cut. Full pieces are sequences by themselves. The others
    are dealt by hash into groups of about `group_size`, so that no task packs more than that at any input size, and
    each group is packed by the sum-of-squares rule, longest first. Sequences filled less than `well_filled` are taken
    apart and their pieces packed again over larger hash groups' leftovers. Offsets are gapless from 0.

    A null or empty text is one piece with id 0 alone. Repeated rows are packed each. An empty table gives no rows.
    Extra columns are ignored unless carried in row (doc_id by default).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = token_pieces(docs, vocabulary or default_vocabulary(), capacity, carry or ["doc_id"], with_ids=with_ids)
    pieces = scratch.write(pieces.withColumn("k", F.monotonically_increasing_id()))
    small = pieces.where(F.col("length") < capacity).select("k", "length")
    count = small.count()
    groups = max(16 if count > 4000 else 1, -(-count // group_size))
    first = scratch.write(_pack_groups(small, groups, capacity, 0))
    loose = first.where(F.col("filled") < int(well_filled * capacity)).select("k", "length")
    again = _pack_groups(loose, max(1, -(-loose.count() // group_size)), capacity, 1)
    placed = first.where(F.col("filled") >= int(well_filled * capacity)).unionByName(again).drop("length", "filled")
    short = pieces.where(F.col("length") < capacity).join(placed, "k")
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.col("k")).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(full).drop("k")
