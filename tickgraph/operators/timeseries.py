"""Incremental time-series operators as window expressions; recurrences that are no window run in the keyed fold.

Frames are in ticks of the input, never in time, but for the time delay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import ieee
from . import steps
from .folds import keyed_fold
from .nodes import Builder, Node, column_name

START = Window.unboundedPreceding


class SeriesNode(Node):
    """Columns in stages over one window per key; the stage '' is the value, others are named after it."""

    kind = "TimeSeries"
    eager = True
    fold_type: str | None = None

    def step(self) -> steps.Step:
        raise NotImplementedError

    def stages(self, x: Column, w: Callable, c: Callable) -> list[tuple[str, Callable[[], Column]]]:
        raise NotImplementedError

    def build(self, b: Builder) -> None:
        name = column_name(self.name)
        tick = b.any_tick(name, self.inputs)
        b.ticks[self] = tick
        if self.fold_type:
            b.fold(name, self.step(), [column_name(i.name) for i in self.inputs], self.fold_type, tick)
            return
        own = f"{name}__at" if tick else name

        def w(*rows: int):
            return b.window(tick, rows or None)

        def c(suffix: str = "") -> Column:
            return F.col(f"{own}__{suffix}" if suffix else own)

        done = []
        for suffix, value in self.stages(self.inputs[0].column, w, c):
            b.add(f"{own}__{suffix}" if suffix else own, value())
            done.append(suffix)
        if tick:
            held = b.window(rows=(START, 0))
            for suffix in done:
                at = F.last(F.when(F.col(tick), F.struct(c(suffix).alias("v"))), ignorenulls=True).over(held)["v"]
                b.add(f"{name}__{suffix}" if suffix else name, at)


def _at_least_one(n: int, name: str) -> int:
    if n < 1:
        raise InvalidArgument(f"{name}: window must be at least 1, not {n}")
    return n


class WindowNode(SeriesNode):
    """The last `capacity` values, oldest first."""

    def __init__(self, name, up, capacity):
        super().__init__(name, [up])
        self.capacity = _at_least_one(capacity, name)

    def step(self):
        return steps.WindowStep(self.capacity)

    def stages(self, x, w, c):
        return [("", lambda: F.collect_list(x).over(w(1 - self.capacity, 0))), *_status(w, self.capacity)]


def _status(w, capacity: int) -> list:
    """Filled and capacity of a window: filled = ticks so far, at most capacity."""
    return [("filled", lambda: F.least(F.row_number().over(w()), F.lit(capacity)).cast("long"))]


def window_status(node: Node, capacity: int) -> dict[str, Column]:
    filled = node.extra("filled")
    full = (F.lit(capacity) > 0) & (filled >= capacity)
    return {"capacity": F.lit(capacity).cast("long"), "filled": filled, "full": full, "fraction": ieee.div(filled, float(capacity))}


class RollingStats(SeriesNode):
    """Mean of the last N; columns __var, __sd, __count, and __prev_mean, __prev_sd before the sample joined.

    Sample variance, 0 and not null below two values. A NaN leaves with its window.
    """

    def __init__(self, name, up, window):
        super().__init__(name, [up])
        self.window = _at_least_one(window, name)

    def step(self):
        return steps.RollingStatsStep(self.window)

    def stages(self, x, w, c):
        own, before = w(1 - self.window, 0), w(-self.window, -1)
        zero = F.lit(0.0)
        return [
            ("", lambda: F.avg(x).over(own)),
            ("var", lambda: F.coalesce(F.var_samp(x).over(own), zero)),
            ("sd", lambda: F.coalesce(F.stddev_samp(x).over(own), zero)),
            ("count", lambda: F.count(x).over(own)),
            ("prev_mean", lambda: F.coalesce(F.avg(x).over(before), zero)),
            ("prev_sd", lambda: F.coalesce(F.stddev_samp(x).over(before), zero)),
            *_status(w, self.window),
        ]

    def partials(self, *xs):
        return [ieee.div(1.0, self.extra("count"))]

    def as_step(self):
        return True

    def apply(self, *xs):
        return self.column + ieee.div(xs[0] - self.inputs[0].column, self.extra("count"))


class RollingSum(SeriesNode):
    def __init__(self, name, up, window):
        super().__init__(name, [up])
        self.window = _at_least_one(window, name)

    def step(self):
        return steps.RollingSumStep(self.window)

    def stages(self, x, w, c):
        return [("", lambda: F.sum(x).over(w(1 - self.window, 0))), *_status(w, self.window)]

    def partials(self, *xs):
        return [F.lit(1.0)]

    def as_step(self):
        return True

    def apply(self, *xs):
        return self.column + (xs[0] - self.inputs[0].column)


class RollingMinMax(SeriesNode):
    """A struct of min and max of the last N."""

    def __init__(self, name, up, window):
        super().__init__(name, [up])
        self.window = _at_least_one(window, name)

    def step(self):
        return steps.RollingMinMaxStep(self.window)

    def stages(self, x, w, c):
        own = w(1 - self.window, 0)
        return [
            ("min", lambda: F.min(x).over(own)),
            ("max", lambda: F.max(x).over(own)),
            ("", lambda: F.struct(c("min").alias("min"), c("max").alias("max"))),
            *_status(w, self.window),
        ]


class Ewma(SeriesNode):
    """First x, then alpha x + (1 - alpha) previous.

    As sums of scaled samples in chunks of so many ticks that a weight falls below 2^-60 and no scale overflows; a
    chunk adds the end of the chunk before it. So it is a window for keys of any length.
    """

    def __init__(self, name, up, alpha):
        super().__init__(name, [up])
        self.alpha = alpha
        self.step()

    def step(self):
        return steps.EwmaStep(self.alpha, self.name)

    def stages(self, x, w, c):
        number = ("n", lambda: F.row_number().over(w()))
        if self.alpha == 1:
            return [("", lambda: x), number]
        d = 1 - self.alpha
        size = max(1, math.ceil(60 * math.log(2) / -math.log(d)))

        def local():
            term = F.when(c("n") == 1, x).otherwise(self.alpha * x) * F.pow(F.lit(d), -c("p"))
            return F.sum(term).over(self._by(c("chunk"))) * F.pow(F.lit(d), c("p"))

        def value():
            before = F.last(F.when(c("p") == size - 1, c("local")), ignorenulls=True).over(w(START, -1))
            return c("local") + F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(d), c("p") + 1)

        return [
            number,
            ("p", lambda: ((c("n") - 1) % size).cast("double")),
            ("chunk", lambda: F.floor((c("n") - 1) / size)),
            ("local", local),
            ("", value),
        ]

    def build(self, b):
        tick = b.any_tick(column_name(self.name), self.inputs)
        keys = [b.key, *([tick] if tick else [])]
        self._by = lambda chunk: Window.partitionBy(*keys, chunk).orderBy(b.seq).rowsBetween(START, 0)
        super().build(b)

    def partials(self, *xs):
        return [F.when(self.extra("n") == 1, F.lit(1.0)).otherwise(F.lit(self.alpha))]

    def as_step(self):
        return True

    def apply(self, *xs):
        slope = F.when(self.extra("n") == 1, F.lit(1.0)).otherwise(F.lit(self.alpha))
        return self.column + slope * (xs[0] - self.inputs[0].column)


class EwmaTickRate(SeriesNode):
    """alpha + (1 - alpha) rate at each tick from 0: in closed form 1 - (1 - alpha)^n. The value is ignored."""

    def __init__(self, name, up, alpha):
        super().__init__(name, [up])
        self.alpha = alpha
        self.step()

    def step(self):
        return steps.TickRateStep(self.alpha, self.name)

    def stages(self, x, w, c):
        return [("", lambda: 1 - F.pow(F.lit(1 - self.alpha), F.row_number().over(w())))]

    def partials(self, *xs):
        return [None]


class Delta(SeriesNode):
    """x minus the previous x; 0 at first."""

    def step(self):
        return steps.DeltaStep()

    def __init__(self, name, up):
        super().__init__(name, [up])

    def stages(self, x, w, c):
        return [("n", lambda: F.row_number().over(w())), ("", lambda: F.coalesce(x - F.lag(x).over(w()), F.lit(0.0)))]

    def partials(self, *xs):
        return [F.when(self.extra("n") > 1, F.lit(1.0)).otherwise(F.lit(0.0))]


class Delay(SeriesNode):
    """The value `delay` ticks ago; the initial one until then. __warm says whether it is past that."""

    def __init__(self, name, up, delay, initial=0.0):
        super().__init__(name, [up])
        self.delay, self.initial = delay, initial
        self.step()

    def step(self):
        return steps.DelayStep(self.delay, self.initial)

    def stages(self, x, w, c):
        value = F.lag(x, self.delay, self.initial).over(w()) if self.delay else x
        return [("", lambda: value), ("warm", lambda: F.row_number().over(w()) > self.delay), *_status(w, self.delay)]

    def partials(self, *xs):
        return [None if self.delay else F.lit(1.0)]

    def as_step(self):
        return not self.delay

    def apply(self, *xs):
        return xs[0] if not self.delay else super().apply(*xs)


class TimeDelay(SeriesNode):
    """The newest value with time <= now - horizon, else null: an as-of join of the stream with itself, as a range frame."""

    def __init__(self, name, up, time, horizon_us):
        super().__init__(name, [up, time])
        self.horizon = horizon_us

    def step(self):
        return steps.TimeDelayStep(self.horizon)

    def build(self, b):
        tick = b.any_tick(column_name(self.name), self.inputs)
        x, t = (i.column for i in self.inputs)
        if not self.horizon:
            b.add(column_name(self.name), x)
        else:
            at = F.when(F.col(tick), x) if tick else x
            order = F.when(at.isNotNull(), F.struct(t, F.col(b.seq)))
            w = Window.partitionBy(b.key).orderBy(t).rangeBetween(START, -self.horizon)
            b.add(column_name(self.name), F.max_by(x, order).over(w))
        b.ticks[self] = tick


class Threshold(SeriesNode):
    """On when x > level, off when x < level - hysteresis (mirrored for below); strict, starts off, NaN changes nothing.

    With a negative hysteresis the two regions overlap and the state toggles in them: that runs in the fold.
    """

    def __init__(self, name, up, level, below=False, hysteresis=0.0):
        super().__init__(name, [up])
        self.level, self.below, self.hysteresis = level, below, hysteresis
        self.fold_type = "boolean" if hysteresis < 0 else None

    def step(self):
        return steps.ThresholdStep(self.level, self.below, self.hysteresis)

    def stages(self, x, w, c):
        if self.below:
            on, off = ieee.lt(x, self.level), ieee.gt(x, self.level + self.hysteresis)
        else:
            on, off = ieee.gt(x, self.level), ieee.lt(x, self.level - self.hysteresis)
        signal = F.when(on, True).when(off, False)
        return [("", lambda: F.coalesce(F.last(signal, ignorenulls=True).over(w(START, 0)), F.lit(False)))]


class ZScore(SeriesNode):
    """(x - mean) / sd of the N samples before x; 0 while that sd is below 1e-12."""

    def __init__(self, name, up, window):
        super().__init__(name, [up])
        self.window = _at_least_one(window, name)

    def step(self):
        return steps.ZScoreStep(self.window)

    def stages(self, x, w, c):
        before = w(-self.window, -1)
        return [
            ("prev_mean", lambda: F.coalesce(F.avg(x).over(before), F.lit(0.0))),
            ("prev_sd", lambda: F.coalesce(F.stddev_samp(x).over(before), F.lit(0.0))),
            ("", lambda: self.scored(x, c("prev_mean"), c("prev_sd"))),
        ]

    @staticmethod
    def scored(x, mean, sd) -> Column:
        return F.when(sd < 1e-12, F.lit(0.0)).otherwise(ieee.div(x - mean, sd))

    def partials(self, *xs):
        sd = self.extra("prev_sd")
        return [F.when(sd < 1e-12, F.lit(0.0)).otherwise(ieee.div(1.0, sd))]

    def as_step(self):
        return True

    def apply(self, *xs):
        return self.scored(xs[0], self.extra("prev_mean"), self.extra("prev_sd"))


class OutlierGate(SeriesNode):
    """The rolling mean with x in it where |z| >= threshold, else x. The window keeps the raw samples."""

    def __init__(self, name, up, window, threshold=3.0):
        super().__init__(name, [up])
        self.window, self.threshold = _at_least_one(window, name), threshold

    def step(self):
        return steps.OutlierGateStep(self.window, self.threshold)

    def stages(self, x, w, c):
        own, before = w(1 - self.window, 0), w(-self.window, -1)
        return [
            ("mean", lambda: F.avg(x).over(own)),
            ("count", lambda: F.count(x).over(own)),
            ("prev_mean", lambda: F.coalesce(F.avg(x).over(before), F.lit(0.0))),
            ("prev_sd", lambda: F.coalesce(F.stddev_samp(x).over(before), F.lit(0.0))),
            ("outlier", lambda: ieee.ge(F.abs(ZScore.scored(x, c("prev_mean"), c("prev_sd"))), self.threshold)),
            ("", lambda: F.when(c("outlier"), c("mean")).otherwise(x)),
        ]

    def partials(self, *xs):
        return [F.when(self.extra("outlier"), ieee.div(1.0, self.extra("count"))).otherwise(F.lit(1.0))]

    def as_step(self):
        return True

    def apply(self, *xs):
        z = ZScore.scored(xs[0], self.extra("prev_mean"), self.extra("prev_sd"))
        mean = self.extra("mean") + ieee.div(xs[0] - self.inputs[0].column, self.extra("count"))
        return F.when(ieee.ge(F.abs(z), self.threshold), mean).otherwise(xs[0])


class RateLimiter(SeriesNode):
    """x if it is at least min_delta from the last x let through, else that one: greedy, so a fold."""

    fold_type = "double"

    def __init__(self, name, up, min_delta):
        super().__init__(name, [up])
        self.min_delta = min_delta

    def step(self):
        return steps.RateLimiterStep(self.min_delta)

    def build(self, b):
        name = column_name(self.name)
        tick = b.any_tick(name, self.inputs)
        b.ticks[self] = tick
        up = [column_name(self.inputs[0].name)]
        folds = {name: (self.step(), up, self.fold_type), f"{name}__passed": (steps.PassedStep(self.min_delta), up, "boolean")}
        b.df = keyed_fold(b.df, b.key, b.seq, folds, dict.fromkeys(folds, tick) if tick else None)

    def partials(self, *xs):
        """1 where the sample was let through; a held one has 0, equal to the last one let through or not."""
        return [F.when(self.extra("passed"), F.lit(1.0)).otherwise(F.lit(0.0))]


class DebounceCount(SeriesNode):
    """Whether at least `required` trues in a row came last; always true for 0."""

    def __init__(self, name, up, required):
        super().__init__(name, [up])
        self.required = required

    def step(self):
        return steps.DebounceStep(self.required)

    def stages(self, x, w, c):
        false_at = F.last(F.when(~x, c("n")), ignorenulls=True)
        return [
            ("n", lambda: F.row_number().over(w())),
            ("run", lambda: (c("n") - F.coalesce(false_at.over(w(START, 0)), F.lit(0))).cast("long")),
            ("", lambda: c("run") >= self.required),
        ]


class LatchedDebounce(DebounceCount):
    """True at the tick a run of trues reaches `required`, false at the first false after such a run, else null."""

    def step(self):
        return steps.LatchedDebounceStep(self.required)

    def stages(self, x, w, c):
        need = max(self.required, 1)
        before = F.coalesce(F.lag(c("run")).over(w()), F.lit(0))
        return [
            *super().stages(x, w, c)[:2],
            ("", lambda: F.when(c("run") == need, F.lit(True)).when(~x & (before >= need), F.lit(False))),
        ]
