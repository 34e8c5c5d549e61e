"""The same steps on Structured Streaming: keyed state, checkpointed, one output row for each input row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.steps import Step
from ..sources.scratch import Scratch


def stream_fold(stream: DataFrame, key: str, seq: str, value: str, step: Step, kind: str = "double") -> DataFrame:
    """(key, seq, y) of a stream of (key, seq, value): the step over each key in order of seq within a micro-batch.

    The state is the step's, as JSON, in the state store. Rows of a key that come in a later batch must have a later
    seq. A null value gives the output before it; NaN is a value.
    """
    names = stream.schema

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else {"s": step.start(), "y": None}
        parts = list(frames)
        rows = pd.concat(parts).sort_values(seq, kind="stable") if parts else pd.DataFrame(columns=[seq, value, "__none"])
        out = []
        for x, none in zip(rows[value].tolist(), rows["__none"].tolist(), strict=True):
            x = None if none else x
            if x is not None or step.nulls:
                own["y"] = step.step(own["s"], x)
            out.append(own["y"])
        state.update((json.dumps(own),))
        yield pd.DataFrame({key: [keys[0]] * len(out), seq: rows[seq].tolist(), "y": out})

    schema = f"`{key}` {names[key].dataType.simpleString()}, `{seq}` {names[seq].dataType.simpleString()}, y {kind}"
    grouped = stream.select(key, seq, value, F.col(value).isNull().alias("__none")).groupBy(key)
    return grouped.applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Runs the stream; callback(batch, number) for each micro-batch. interval None: all that is there, then stop."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(callback)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def replay_stream(spark: SparkSession, path: str, key: str, seq: str, value: str, step: Step) -> DataFrame:
    """A recorded table through the streaming path, to its end: (key, seq, y)."""
    return replayed(spark, path, lambda stream: stream_fold(stream, key, seq, value, step))


def replayed(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `change` makes of a recorded table as a stream, run to its end."""
    scratch = Scratch(spark, "stream")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder, _, name = path.rpartition("/")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", name), folder  # a file stream watches a folder
    stream = reader.parquet(path)
    out = change(stream)
    target = f"{scratch.root}/out"
    query = out.writeStream.outputMode("append").option("checkpointLocation", f"{scratch.root}/checkpoint").format("parquet").option("path", target)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


class CycleStats:
    """Counts and durations of micro-batches, from a query's recent progress."""

    def __init__(self, query, window: int = 1000):
        if window < 1:
            raise ValueError("window must be at least 1")
        self.query, self.window = query, window

    def summary(self) -> dict[str, float]:
        times = [p["batchDuration"] * 1000 for p in self.query.recentProgress if p.get("batchDuration") is not None]
        recent = times[-self.window :]
        return {
            "cycles": len(times),
            "last_us": times[-1] if times else 0,
            "mean_us": sum(times) / len(times) if times else 0.0,
            "min_us": min(times, default=0),
            "max_us": max(times, default=0),
            "rolling_mean_us": sum(recent) // len(recent) if recent else 0,
        }


def expiring(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with a watermark, for sources whose rows may come late."""
    return stream.withWatermark(time, delay).where(F.col(time).isNotNull())
