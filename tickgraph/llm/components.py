"""Connected components by alternating large and small stars, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

ROWS_PER_TASK = 50_000


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of long ids -> (id, component) of each id that has an edge to another one.

    component is the smallest reachable id. Self-loops, repeats and nulls count as nothing; an empty table gives
    an empty table. A round points each id at the least of its neighbours (large star), then at the least of what
    those points share (small star), until only stars are left. It reduces by key with map-side combining; where one id
    has very many edges, the join has two shuffled sides, which adaptive execution splits. Tasks follow the rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.write(edges)
    for _ in range(max_rounds):
        rows = edges.count()
        tasks = 8 + rows // ROWS_PER_TASK
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = scratch.write(least.select(F.col("a").alias("b"), F.least("m", "a").alias("m")).coalesce(tasks))
        large = edges.join(least, "b").select("a", F.col("m").alias("b"), (F.col("m") != F.col("b")).alias("moved"))
        large = scratch.write(large.coalesce(tasks))
        state = large.groupBy("a").agg(F.max("moved").alias("moved"), F.count("*").alias("n"))
        moved, n = state.agg(F.max("moved"), F.max("n")).first()
        if not rows or (not moved and n == 1):
            scratch.free(least, large)
            break
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        other = large.join(least2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = other.union(least2.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.write(new.coalesce(tasks))
        scratch.free(edges, least, large)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(own)
