"""Typed nodes of a graph: sources, functions, choices and overrides. Each becomes columns of an ordered keyed stream."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DomainError, InvalidArgument
from ..functions import dual, ieee, scalar
from .folds import keyed_fold
from .policies import AlwaysChanged, Policy, TypedEquality
from .steps import PublishStep, Step


def column_name(name: str) -> str:
    return name.replace(".", "__")


class Builder:
    """A stream under construction; every node adds its columns once, in topological order."""

    def __init__(self, df: DataFrame, key: str, seq: str):
        self.df, self.key, self.seq = df, key, seq
        self.ticks: dict[Node, str | None] = {}

    def add(self, name: str, value: Column) -> Column:
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def window(self, tick: str | None = None, rows: tuple[int, int] | None = None):
        """Rows of a key in order; with a tick column those of the same tick only, which needs no further shuffle."""
        w = Window.partitionBy(*[self.key, *([tick] if tick else [])]).orderBy(self.seq)
        return w.rowsBetween(*rows) if rows else w

    def fold(self, name: str, step: Step, inputs: list[str], kind: str, tick: str | None) -> None:
        self.df = keyed_fold(self.df, self.key, self.seq, {name: (step, inputs, kind)}, {name: tick} if tick else None)

    def any_tick(self, name: str, nodes) -> str | None:
        """The column that says whether any of these nodes ticked; None if one always does."""
        columns = [self.ticks[n] for n in nodes]
        if not columns or None in columns:
            return None if columns else None
        columns = sorted(set(columns))
        if len(columns) == 1:
            return columns[0]
        test = F.lit(False)
        for c in columns:
            test = test | F.col(c)
        self.add(f"{name}__tick", test)
        return f"{name}__tick"


class Node:
    """A named vertex. Eager nodes advance whenever anything upstream ticked, lazy ones hold a pure value."""

    kind = "Compute"
    eager = False
    suffixes: tuple[str, ...] = ()

    def __init__(self, name: str, inputs: list[Node]):
        if any(i is None for i in inputs):
            raise InvalidArgument(f"{name}: null input")
        self.name, self.inputs = name, list(inputs)

    @property
    def column(self) -> Column:
        return F.col(column_name(self.name))

    def extra(self, suffix: str) -> Column:
        return F.col(f"{column_name(self.name)}__{suffix}")

    def build(self, b: Builder) -> None:
        b.add(column_name(self.name), self.apply(*[i.column for i in self.inputs]))
        b.ticks[self] = b.any_tick(column_name(self.name), self.inputs)

    def apply(self, *xs: Column) -> Column:
        """The node's function of input values; what a reduction calls with trial values."""
        raise DomainError(f"{self.name} cannot be called at trial values")

    def partials(self, *xs: Column) -> list[Column | None] | None:
        """One derivative for each input (None: does not depend on it); None altogether for a barrier."""
        return None

    def as_step(self) -> bool:
        """Whether a reduction may run it."""
        return False


class Constant(Node):
    def __init__(self, name: str, value: Any):
        super().__init__(name, [])
        self.value = value

    def apply(self, *xs):
        return F.lit(self.value)

    def partials(self, *xs):
        return []

    def build(self, b):
        b.add(column_name(self.name), F.lit(self.value))
        b.add(f"{column_name(self.name)}__tick", F.row_number().over(b.window()) == 1)
        b.ticks[self] = f"{column_name(self.name)}__tick"


class Source(Node):
    """A column of the stream. A null is no sample: the value before it, or the initial one, stays.

    Its policy says when a value is a tick: with the default, a repeated value is none, so windows below do not move;
    with AlwaysChanged every row is one. The first row of a key always ticks.
    """

    kind = "Input"

    def __init__(self, name: str, column: str, policy: Policy | None = None, initial: Any = None, kind: str = "double"):
        super().__init__(name, [])
        self.source, self.policy, self.initial, self.type = column, policy or TypedEquality(), initial, kind

    def partials(self, *xs):
        return []

    def build(self, b):
        name, tick = column_name(self.name), f"{column_name(self.name)}__tick"
        raw = F.col(self.source)
        filled = F.last(raw, ignorenulls=True).over(b.window(rows=(Window.unboundedPreceding, 0)))
        if self.initial is not None:
            filled = F.coalesce(filled, F.lit(self.initial))
        first = F.row_number().over(b.window()) == 1
        if self.policy.always:
            b.add(name, raw if self.initial is None else filled)
            b.ticks[self] = None
            return
        if self.policy.greedy:
            sent = PublishStep(self.policy, self.initial)
            b.add(f"{name}__raw", raw)
            folds = {f"{name}__held": (_Part(sent, 0), [f"{name}__raw"], self.type), f"{name}__sent": (_Part(sent, 1), [f"{name}__raw"], "boolean")}
            b.df = keyed_fold(b.df, b.key, b.seq, folds)
            b.add(name, F.col(f"{name}__held") if self.initial is None else F.coalesce(f"{name}__held", F.lit(self.initial)))
            change = raw.isNotNull() & F.coalesce(f"{name}__sent", F.lit(False))  # a published value may equal the one before
        else:
            b.add(name, filled)
            before = F.lag(name).over(b.window())
            change = ieee.differs(F.col(name), before) if self.type == "double" else ~F.col(name).eqNullSafe(before)
            change = change & raw.isNotNull()
        b.add(tick, first | change)
        b.ticks[self] = tick


class _Part(Step):
    """One of the values of a step that gives several."""

    def __init__(self, step: Step, part: int):
        self.inner, self.part = step, part

    def start(self):
        return self.inner.start()

    def step(self, state, x):
        return self.inner.step(state, x)[self.part]


class OpNode(Node):
    """One of the scalar operators over its inputs: lazy, with closed-form partials."""

    def __init__(self, name: str, op: str | scalar.Op, *inputs: Node):
        super().__init__(name, list(inputs))
        self.op = scalar.OPS[op] if isinstance(op, str) else op

    def apply(self, *xs):
        return self.op.value(*xs)

    def partials(self, *xs):
        return self.op.partials(*xs) if self.op.partials else None

    def as_step(self):
        return True


class ComputeNode(Node):
    """A function of columns. Opaque to derivatives; a lazy one may be called at trial values."""

    def __init__(self, name: str, inputs: list[Node], fn: Callable[..., Column], eager: bool = True):
        super().__init__(name, inputs)
        self.fn, self.eager = fn, eager

    def apply(self, *xs):
        return ieee.col(self.fn(*xs))

    def as_step(self):
        return not self.eager


class DifferentiableNode(Node):
    """A function written for dual numbers: one definition gives value and partials."""

    def __init__(self, name: str, inputs: list[Node], fn: Callable, eager: bool = True):
        super().__init__(name, inputs)
        self.fn, self.eager = fn, eager

    def apply(self, *xs):
        return dual.value(self.fn(*xs))

    def partials(self, *xs):
        return dual.partials_of(self.fn, *xs)[1]

    def as_step(self):
        return True


class ConditionNode(Node):
    """condition ? a : b. It ticks with the condition and the branch taken; a stateful branch moves only while taken."""

    def __init__(self, name: str, condition: Node, a: Node, b: Node):
        super().__init__(name, [condition, a, b])

    def apply(self, *xs):
        return F.when(xs[0], xs[1]).otherwise(xs[2])

    def partials(self, *xs):
        return [None, F.when(xs[0], 1.0).otherwise(0.0), F.when(xs[0], 0.0).otherwise(1.0)]

    def as_step(self):
        return True

    def build(self, b):
        super().build(b)
        condition, left, right = (b.ticks[i] for i in self.inputs)
        if condition is None or (left is None and right is None):
            b.ticks[self] = None
            return
        taken = F.when(self.inputs[0].column, F.col(left) if left else F.lit(True)).otherwise(F.col(right) if right else F.lit(True))
        b.add(f"{column_name(self.name)}__tick", F.col(condition) | taken)
        b.ticks[self] = f"{column_name(self.name)}__tick"


class TakenWhen(Node):
    """A source's value seen only while a condition has a given value: put under a stateful branch of a ConditionNode."""

    eager = True

    def __init__(self, name: str, inner: Node, condition: Node, value: bool):
        super().__init__(name, [inner, condition])
        self.value = value

    def build(self, b):
        b.add(column_name(self.name), self.inputs[0].column)
        own = b.any_tick(f"{column_name(self.name)}__own", self.inputs)
        taken = self.inputs[1].column == F.lit(self.value)
        b.add(f"{column_name(self.name)}__tick", taken & F.col(own) if own else taken)
        b.ticks[self] = f"{column_name(self.name)}__tick"

    def partials(self, *xs):
        return [F.lit(1.0), None]


class TweakableNode(Node):
    """A computed value that a log of tweaks overrides: from a 'tweak' on it stands at the tweak's value until a 'clear'.

    A tweaked node absorbs the ticks above it; it ticks where the tweak itself changes.
    """

    def __init__(self, name: str, inputs: list[Node], fn: Callable[..., Column], action: str, value: str, eager: bool = True):
        super().__init__(name, inputs)
        self.fn, self.action, self.value, self.eager = fn, action, value, eager

    def apply(self, *xs):
        return ieee.col(self.fn(*xs))

    def as_step(self):
        return not self.eager

    def build(self, b):
        name = column_name(self.name)
        event = F.when(F.col(self.action) == "tweak", F.struct(F.lit(True).alias("on"), F.col(self.value).alias("v")))
        event = event.when(F.col(self.action) == "clear", F.struct(F.lit(False).alias("on"), F.lit(None).cast("double").alias("v")))
        state = b.add(f"{name}__tweak", F.last(event, ignorenulls=True).over(b.window(rows=(Window.unboundedPreceding, 0))))
        on = F.coalesce(state["on"], F.lit(False))
        b.add(f"{name}__tweaked", on)
        b.add(name, F.when(on, state["v"]).otherwise(self.apply(*[i.column for i in self.inputs])))
        above = b.any_tick(f"{name}__above", self.inputs)
        before = F.lag(f"{name}__tweak").over(b.window())
        b.add(f"{name}__moved", ~F.col(f"{name}__tweak").eqNullSafe(before) | (F.row_number().over(b.window()) == 1))
        b.add(f"{name}__tick", F.col(f"{name}__moved") | (~on & (F.col(above) if above else F.lit(True))))
        b.ticks[self] = f"{name}__tick"


class FeedbackNode(Node):
    """y[i] = fn(x[i], y[i - 1]): an output fed back to an input, one cycle later."""

    eager = True

    def __init__(self, name: str, inner: Node, fn: Callable, initial: float = 0.0):
        super().__init__(name, [inner])
        self.fn, self.initial = fn, initial

    def build(self, b):
        from .steps import FeedbackStep

        tick = b.any_tick(column_name(self.name), self.inputs)
        b.fold(column_name(self.name), FeedbackStep(self.fn, self.initial), [column_name(self.inputs[0].name)], "double", tick)
        b.ticks[self] = tick


ALWAYS = AlwaysChanged()
