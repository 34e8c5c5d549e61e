"""Feeds: latest value of a cycle, batches, groups of sources, and recorded streams played against a schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument


def latest_wins(df: DataFrame, key: list[str], seq: str, value: str) -> DataFrame:
    """The last post of each cycle, and how many posts it overwrote: (key..., value, skipped)."""
    return df.groupBy(*key).agg(F.max_by(value, seq).alias(value), (F.count("*") - 1).alias("skipped"))


def queue_batches(df: DataFrame, key: list[str], seq: str, value: str, capacity: int = 4096) -> DataFrame:
    """The batch of each cycle in order of arrival, of the newest `capacity` posts, and how many older were dropped.

    Ranks come from a window, so a cycle with very many posts spills instead of filling one array: (key..., batch, dropped).
    """
    if capacity < 1:
        raise InvalidArgument("capacity must be at least 1")
    newest = Window.partitionBy(*key).orderBy(F.desc(seq))
    ranked = df.withColumn("__rank", F.row_number().over(newest))
    kept = F.collect_list(F.when(F.col("__rank") <= capacity, F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    return ranked.groupBy(*key).agg(
        F.transform(F.array_sort(kept), lambda x: x["v"]).alias("batch"),
        F.greatest(F.count("*") - capacity, F.lit(0)).alias("dropped"),
    )


def queue_cycles(cycles: DataFrame, posts: DataFrame, key: list[str], cycle: str, seq: str, value: str, capacity: int = 4096) -> DataFrame:
    """What a queue hands over at each of the given cycles: (key..., cycle, batch, dropped_count).

    A cycle without posts has an empty batch; dropped_count counts all posts that the queue has dropped up to there.
    """
    batches = queue_batches(posts, [*key, cycle], seq, value, capacity)
    joined = cycles.select(*key, cycle).join(batches, [*key, cycle], "left")
    so_far = Window.partitionBy(*key).orderBy(cycle).rowsBetween(Window.unboundedPreceding, 0)
    empty = F.array().cast(batches.schema["batch"].dataType)
    return joined.select(*key, cycle, F.coalesce("batch", empty).alias("batch"), F.sum(F.coalesce("dropped", F.lit(0))).over(so_far).alias("dropped_count"))


def registry(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Tagged sources of one schema as one; a source given twice under its name counts once."""
    out = None
    for name, df in dict(sources).items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise InvalidArgument("no source")
    return out


def replay_clock(schedule: DataFrame, seq: str = "seq", ts: str = "ts_us", base: int = 0, key: list[str] | None = None) -> DataFrame:
    """The schedule with now_us = base + (its time - the first time)."""
    w = Window.partitionBy(*(key or [])).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return schedule.withColumn("now_us", F.lit(base) + F.col(ts) - F.first(ts).over(w))


def check_schedule(schedule: DataFrame, seq: str = "seq") -> None:
    """seq must be 1 or more and distinct."""
    row = schedule.agg(F.min(seq).alias("low"), F.count(seq).alias("n"), F.countDistinct(seq).alias("d")).first()
    if row["n"] and (row["low"] < 1 or row["n"] != row["d"]):
        raise InvalidArgument("a schedule needs distinct sequence numbers from 1 on")


def replay_input(
    schedule: DataFrame, samples: DataFrame, name: str, initial: Column | float = 0.0, seq: str = "seq", value: str = "value", key: list[str] | None = None
) -> DataFrame:
    """The schedule with a recorded stream: a sample on its own cycle, the one before it elsewhere, `initial` at first.

    Exact alignment: samples whose seq is not scheduled are never delivered.
    """
    key = key or []
    mine = samples.select(*key, seq, F.struct(F.col(value).alias("v")).alias(f"__{name}"))
    joined = schedule.join(mine, [*key, seq], "left")
    w = Window.partitionBy(*key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(f"__{name}", ignorenulls=True).over(w)
    initial = initial if isinstance(initial, Column) else F.lit(initial)
    return joined.withColumn(name, F.when(held.isNull(), initial).otherwise(held["v"])).drop(f"__{name}")


def replay_queue(schedule: DataFrame, batches: DataFrame, name: str, seq: str = "seq", batch: str = "batch", key: list[str] | None = None) -> DataFrame:
    """The schedule with the batch of each cycle, an empty one where none was recorded."""
    key = key or []
    joined = schedule.join(batches.select(*key, seq, F.col(batch).alias(name)), [*key, seq], "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(batches.schema[batch].dataType)))


def drained(schedule: DataFrame, cycles: int = 1, seq: str = "seq", ts: str = "ts_us") -> DataFrame:
    """The schedule and `cycles` empty cycles after its last."""
    last = schedule.agg(F.max(F.struct(seq, ts)).alias("m")).where("m is not null")
    more = last.select(F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("k"), "m")
    return schedule.select(seq, ts).union(more.select((F.col(f"m.{seq}") + F.col("k")).alias(seq), F.col(f"m.{ts}").alias(ts)))
