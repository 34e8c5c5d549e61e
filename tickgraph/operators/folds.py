"""The keyed fold: recurrences that are no window, one ordered pass in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .steps import Step

#: name of the output -> (step, input columns, output type as in Spark's DDL)
Folds = dict[str, tuple[Step, list[str], str]]


def keyed_fold(df: DataFrame, key: str, seq: str, folds: Folds, ticks: dict[str, str] | None = None) -> DataFrame:
    """df with one column more for each fold; all folds share the pass.

    Rows are dealt by key and sorted by (key, seq); a task walks its partition once and holds the state of one key, so
    a long key costs time but no memory. ticks names a boolean column by output: the step runs only where it is true and
    the output holds its value elsewhere. Null inputs reach the step only if it takes them; here they hold the value.
    """
    ticks = ticks or {}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {t}" for n, (_, _, t) in folds.items()])

    def run(batches):
        current, states, held = object(), {}, {}
        for batch in batches:
            keys = batch.column(key).to_pylist()
            inputs = {n: [batch.column(c).to_pylist() for c in cols] for n, (_, cols, _) in folds.items()}
            gates = {n: batch.column(c).to_pylist() for n, c in ticks.items()}
            outs: dict[str, list] = {n: [] for n in folds}
            for i, k in enumerate(keys):
                if k != current:
                    current, states, held = k, {n: s.start() for n, (s, _, _) in folds.items()}, dict.fromkeys(folds)
                for n, (step, _, _) in folds.items():
                    xs = [c[i] for c in inputs[n]]
                    if (n not in gates or gates[n][i]) and (xs[0] is not None or step.nulls):
                        held[n] = step.step(states[n], xs[0] if len(xs) == 1 else tuple(xs))
                    outs[n].append(held[n])
            extra = [pa.array(v, types[n]) for n, v in outs.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *folds])

    types = {n: _arrow(t) for n, (_, _, t) in folds.items()}
    return df.repartition(key).sortWithinPartitions(key, seq).mapInArrow(run, schema)


def _arrow(ddl: str) -> pa.DataType:
    return {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[ddl]


def fold_list(step: Step, xs: list, of: Callable = lambda state, y: y) -> list:
    """The step over a list; what the window forms are tested against."""
    state = step.start()
    return [of(state, step.step(state, x)) for x in xs]
