"""Embedding near-duplicates: an epsilon grid order join on the leading principal dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from ..sources.scratch import Scratch

#: Slack of the grid against rounding of the projected coordinates.
SLACK = 1e-6
#: Blocks of an interval of the order.
INTERVAL = 32


def principal_axes(moments: np.ndarray, count: int) -> np.ndarray:
    """Orthonormal axes of largest spread, from the summed outer products of all unit vectors."""
    _, axes = np.linalg.eigh(moments / max(count, 1))
    return axes[:, ::-1]


def _unit(column: pa.Array, size: int) -> np.ndarray:
    """Usable vectors of `size` numbers scaled to length 1, in double precision; the largest number is taken out first,
    so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def join_blocks(x: np.ndarray, y: np.ndarray, threshold: float, eps: float, leaf: int = 64, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with x[i] . y[j] >= threshold, of unit vectors in grid order in rotated coordinates.

    Two intervals of the order are halved and joined recursively; a pair of intervals is skipped when the boxes around
    them are further apart than eps, which no linked pair is. For one interval with itself only i < j.
    """
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    todo = [(0, len(x), 0, len(y))] if len(x) and len(y) else []
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(which: int, z: np.ndarray, a: int, b: int):
        if (which, a, b) not in boxes:
            boxes[which, a, b] = z[a:b].min(axis=0), z[a:b].max(axis=0)
        return boxes[which, a, b]

    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        lo, hi = box(0, x, a, b)
        lo2, hi2 = box(0 if same else 1, y, c, d)
        gap = np.maximum(0, np.maximum(lo2 - hi, lo - hi2))
        if np.dot(gap, gap) > (eps + SLACK) ** 2:
            continue
        if b - a <= leaf and d - c <= leaf or (b - a <= 8 * leaf and d - c <= 8 * leaf and not gap.any()):
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= threshold)
            if same:
                keep = i + a < j + c
                i, j = i[keep], j[keep]
            left.append(i + a)
            right.append(j + c)
            continue
        if b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its tree) of what these links join: at most one for each vector."""
    parent = np.arange(len(ids))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                if ids[p] > ids[q]:
                    p, q = q, p
                parent[q] = p
    root = np.array([find(k) for k in range(len(ids))], np.int64)
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _block_join(threshold: float, eps: float, size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks (or one with itself): links of each class weighted by copies, and a forest of edges."""
        parts = frame.sort_values("second")
        blocks = []
        for row in parts.itertuples():
            blocks.append((np.frombuffer(row.ids, "<i8"), np.frombuffer(row.copies, "<i8"), np.frombuffer(row.vectors, "<f8").reshape(-1, size)))
        ids, copies, x = blocks[0]
        same = len(blocks) == 1
        ids2, copies2, y = blocks[-1]
        i, j = join_blocks(x, y, threshold, eps, same=same)
        all_ids = ids if same else np.concatenate([ids, ids2])
        links = np.zeros(len(all_ids), np.int64)
        j2 = j if same else j + len(ids)
        np.add.at(links, i, copies2[j])
        np.add.at(links, j2, copies[i])
        a, b = _forest([(i, j2)], all_ids)
        hit = links > 0
        return pd.DataFrame({
            "a": np.concatenate([all_ids[hit], a]), "b": np.concatenate([np.full(int(hit.sum()), -1), b]),
            "n": np.concatenate([links[hit], np.zeros(len(a), np.int64)]), "edge": np.concatenate([np.zeros(int(hit.sum()), bool), np.ones(len(a), bool)]),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, dimensions: int = 6, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; links are cosines >= threshold between equal labels.

    Equal vectors of a label are one class: copies link with each other and share their other links, so they are never
    paired. The classes are rotated to principal axes, found from sums over all vectors, sorted by label and by the
    cells of a grid of side eps (the distance of unit vectors at the threshold) on the leading axes, and cut into
    blocks of at most `block` in that order. Pairs of blocks whose boxes are within eps are joined (see join_blocks);
    a block goes only where its box can reach. A block pair returns a count for each class and a forest, so a group of
    near copies never costs more rows than it has members in each block pair.

    Null vectors, zero vectors, those with null or non-finite components and null labels link with nothing; vectors of
    different lengths do not link either, and each length is joined by itself. Ties go to the smallest vec_id; repeated
    rows count as copies of one another. A null vec_id has its class's component. An empty table gives no rows; extra
    columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    base = vectors.select("vec_id", F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    usable = usable & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    usable = usable & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    size = F.when(F.coalesce(usable, F.lit(False)), F.size("embedding"))
    keyed = base.withColumn("size", size).withColumn("h", F.when(size.isNotNull(), F.xxhash64("embedding"))).withColumn("g", F.when(size.isNotNull(), F.hash("embedding")))
    keyed = scratch.write(keyed)
    out = keyed.where("size is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for row in keyed.where("size is not null").select("size").distinct().orderBy("size").collect():
        out = out.unionByName(_of_one_length(keyed.where(F.col("size") == row["size"]).drop("size"), row["size"], threshold, dimensions, block, scratch))
    return out


def _of_one_length(keyed: DataFrame, size: int, threshold: float, dimensions: int, block: int, scratch: Scratch) -> DataFrame:
    """near_duplicates of usable vectors of `size` numbers."""
    spark = keyed.sparkSession
    good = keyed.where("vec_id is not null")
    classes = good.groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.write(classes)
    reps = good.join(classes.select("rep", "copies", F.col("label").alias("l2")), (F.col("vec_id") == F.col("rep")) & (F.col("label") == F.col("l2")))
    reps = scratch.write(reps.select("rep", "copies", "label", "embedding").dropDuplicates(["rep"]))

    def moments(batches):
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            x = _unit(batch.column("embedding"), size)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["m", "n"])

    sums = reps.select("embedding").mapInArrow(moments, "m binary, n long").collect()
    moment = np.sum([np.frombuffer(r["m"], "<f8").reshape(size, size) for r in sums], axis=0)
    axes = spark.sparkContext.broadcast(principal_axes(moment, sum(r["n"] for r in sums)))
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    dims = min(dimensions, size)

    def rotate(batches):
        for batch in batches:
            x = _unit(batch.column("embedding"), size)
            y = x @ axes.value
            cells = np.floor(y[:, :dims] / max(eps, 1e-9)).astype(np.int32)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), len(x), [None, pa.py_buffer(np.ascontiguousarray(y, "<f8").tobytes())])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims, pa.int32()), pa.array(cells.reshape(-1), pa.int32()))
            columns = [batch.column(c) for c in ("rep", "copies", "label")] + [listed, flat.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "copies", "label", "cells", "v"])

    label_type = keyed.schema["label"].dataType.simpleString()
    rotated = reps.mapInArrow(rotate, f"rep long, copies long, label {label_type}, cells array<int>, v binary")
    ordered = rotated.repartitionByRange("label", "cells", "rep").sortWithinPartitions("label", "cells", "rep")

    def cut(batches):
        """Blocks of the order: one label, at most `block` classes, with the box around them on the leading axes."""
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            x = np.frombuffer(b"".join(h[3] for h in held), "<f8").reshape(-1, size)
            box = [x[:, :dims].min(axis=0).tolist(), x[:, :dims].max(axis=0).tolist()]
            ids, copies = (np.array([h[k] for h in held], "<i8").tobytes() for k in (0, 1))
            key = (part << 32) | number
            names = ["block", "label", "lo", "hi", "ids", "copies", "vectors"]
            arrays = [pa.array([key], pa.int64()), pa.array([held[0][2]]).cast(kind), pa.array([box[0]], pa.list_(pa.float64())), pa.array([box[1]], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([ids], pa.binary()), pa.array([copies], pa.binary()), pa.array([x.tobytes()], pa.binary())], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("label").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("rep", "copies", "label", "v")), strict=True):
                if held and (len(held) >= block or row[2] != held[0][2]):
                    yield flush()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield flush()

    blocks = f"block long, label {label_type}, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary"
    blocks = scratch.write(ordered.mapInArrow(cut, blocks))
    # intervals of blocks first, then the blocks of intervals that are near: far parts of the order are skipped whole
    boxes = blocks.select("block", F.expr(f"block div {INTERVAL}").alias("interval"), "label", "lo", "hi")
    corner = lambda f, c: F.array(*[f(F.get(F.col(c), F.lit(k))) for k in range(dims)]).alias(c)
    wide = boxes.groupBy("label", "interval").agg(corner(F.min, "lo"), corner(F.max, "hi"))
    gap = "aggregate(zip_with(zip_with(lo2, hi, (a, b) -> a - b), zip_with(lo, hi2, (a, b) -> a - b), (a, b) -> greatest(0D, a, b)), 0D, (s, v) -> s + v * v)"
    close = F.expr(gap) <= (eps + SLACK) ** 2
    other = wide.select(F.col("interval").alias("interval2"), "label", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    spans = wide.join(other, "label").where((F.col("interval") <= F.col("interval2")) & close).select("label", "interval", "interval2")
    other = boxes.select(F.col("block").alias("second"), F.col("interval").alias("interval2"), "label", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = boxes.join(spans, ["label", "interval"]).join(other, ["label", "interval2"]).where((F.col("block") <= F.col("second")) & close)
    near = scratch.write(near.select("block", "second"))
    content = blocks.select(F.col("block").alias("mine"), "ids", "copies", "vectors")
    ends = near.select("block", "second", F.explode(F.array_distinct(F.array("block", "second"))).alias("mine"))
    work = ends.join(content, "mine").select(F.col("block").alias("first"), F.when(F.col("mine") == F.col("block"), 0).otherwise(1).alias("second"), F.col("second").alias("last"), "ids", "copies", "vectors")
    found = work.groupBy("first", "last").applyInPandas(_block_join(threshold, eps, size), "a long, b long, n long, edge boolean")
    found = scratch.write(found)
    links = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("edge").select("a", "b"), scratch).withColumnRenamed("id", "rep")
    named = classes.join(links, "rep", "left").join(parts, "rep", "left")
    named = named.select("label", "h", "g", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = scratch.write(named)
    linked = keyed.join(named, ["label", "h", "g"], "left")
    linked = linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
