"""Each stateful operator as one step on plain values: what the keyed fold, streaming and the property tests share."""

from __future__ import annotations

import math
from typing import Any

from ..errors import InvalidArgument


class Step:
    """start() gives the state of a key, a JSON-like dict; step(state, x) changes it and gives the output."""

    #: Whether a null input is a step too.
    nulls = False

    def start(self) -> dict[str, Any]:
        return {}

    def step(self, state: dict[str, Any], x):
        raise NotImplementedError


def _positive(n: int, what: str) -> int:
    if n < 1:
        raise InvalidArgument(f"{what} must be at least 1, not {n}")
    return n


class WindowStep(Step):
    def __init__(self, capacity: int):
        self.capacity = _positive(capacity, "capacity")

    def start(self):
        return {"buf": []}

    def step(self, state, x):
        state["buf"] = [*state["buf"], x][-self.capacity :]
        return list(state["buf"])


class RollingStatsStep(Step):
    """Mean of the last N; also var, sd, count, and mean and sd before x joined. Sample variance, 0 below two values."""

    def __init__(self, window: int):
        self.window = _positive(window, "window")

    def start(self):
        return {"buf": [], "prev_mean": 0.0, "prev_sd": 0.0}

    @staticmethod
    def _moments(xs: list[float]) -> tuple[float, float]:
        n = len(xs)
        mean = math.fsum(xs) / n if n else 0.0
        return mean, math.fsum((x - mean) ** 2 for x in xs) / (n - 1) if n > 1 else 0.0

    def step(self, state, x):
        mean, var = self._moments(state["buf"])
        state["prev_mean"], state["prev_sd"] = mean, math.sqrt(var)
        state["buf"] = [*state["buf"], x][-self.window :]
        return self._moments(state["buf"])[0]


class RollingSumStep(Step):
    def __init__(self, window: int):
        self.window = _positive(window, "window")

    def start(self):
        return {"buf": []}

    def step(self, state, x):
        state["buf"] = [*state["buf"], x][-self.window :]
        return math.fsum(state["buf"])


class RollingMinMaxStep(RollingSumStep):
    def step(self, state, x):
        state["buf"] = [*state["buf"], x][-self.window :]
        return min(state["buf"]), max(state["buf"])


class EwmaStep(Step):
    def __init__(self, alpha: float, name: str = "ewma"):
        if not 0 < alpha <= 1:
            raise InvalidArgument(f"{name}: alpha must be in (0, 1], not {alpha}")
        self.alpha = alpha

    def start(self):
        return {"ewma": 0.0, "initialized": False}

    def step(self, state, x):
        state["ewma"] = self.alpha * x + (1 - self.alpha) * state["ewma"] if state["initialized"] else x
        state["initialized"] = True
        return state["ewma"]


class TickRateStep(EwmaStep):
    def start(self):
        return {"rate": 0.0}

    def step(self, state, x):
        state["rate"] = self.alpha + (1 - self.alpha) * state["rate"]
        return state["rate"]


class DeltaStep(Step):
    def start(self):
        return {"prev": 0.0, "has_prev": False}

    def step(self, state, x):
        out = x - state["prev"] if state["has_prev"] else 0.0
        state["prev"], state["has_prev"] = x, True
        return out


class DelayStep(Step):
    def __init__(self, delay: int, initial=0.0):
        if delay < 0:
            raise InvalidArgument(f"delay must not be negative: {delay}")
        self.delay, self.initial = delay, initial

    def start(self):
        return {"buf": [], "warm": False}

    def step(self, state, x):
        buf = [*state["buf"], x]
        state["warm"] = len(buf) > self.delay
        out = buf[0] if state["warm"] else self.initial
        state["buf"] = buf[-self.delay :] if self.delay else []
        return out


class TimeDelayStep(Step):
    """x is (value, time in microseconds): the newest value not younger than the horizon."""

    def __init__(self, horizon_us: int):
        self.horizon = horizon_us

    def start(self):
        return {"held": []}

    def step(self, state, x):
        held = [*state["held"], list(x)]
        due = [k for k, (_, t) in enumerate(held) if t <= x[1] - self.horizon]
        state["held"] = held[due[-1] :] if due else held
        return held[due[-1]][0] if due else None


class ThresholdStep(Step):
    def __init__(self, level: float, below: bool = False, hysteresis: float = 0.0):
        self.level, self.below, self.hysteresis = level, below, hysteresis

    def start(self):
        return {"triggered": False}

    def step(self, state, x):
        if self.below:
            on, off = x < self.level, x > self.level + self.hysteresis
        else:
            on, off = x > self.level, x < self.level - self.hysteresis
        state["triggered"] = not off if state["triggered"] else on
        return state["triggered"]


class ZScoreStep(RollingStatsStep):
    def step(self, state, x):
        super().step(state, x)
        sd = state["prev_sd"]
        return 0.0 if sd < 1e-12 else (x - state["prev_mean"]) / sd


class OutlierGateStep(ZScoreStep):
    def __init__(self, window: int, threshold: float = 3.0):
        super().__init__(window)
        self.threshold = threshold

    def step(self, state, x):
        state["last_was_outlier"] = abs(super().step(state, x)) >= self.threshold
        return self._moments(state["buf"])[0] if state["last_was_outlier"] else x


class RateLimiterStep(Step):
    def __init__(self, min_delta: float):
        self.min_delta = min_delta

    def start(self):
        return {"last": 0.0, "has": False}

    def step(self, state, x):
        if not state["has"] or abs(x - state["last"]) >= self.min_delta:
            state["last"], state["has"] = x, True
        return state["last"]


class PassedStep(RateLimiterStep):
    """Whether the rate limiter lets the sample through."""

    def step(self, state, x):
        passed = not state["has"] or abs(x - state["last"]) >= self.min_delta
        super().step(state, x)
        return passed


class DebounceStep(Step):
    def __init__(self, required: int):
        self.required = required

    def start(self):
        return {"count": 0}

    def step(self, state, b):
        state["count"] = state["count"] + 1 if b else 0
        return state["count"] >= self.required


class LatchedDebounceStep(DebounceStep):
    def start(self):
        return {"count": 0, "latched": False}

    def step(self, state, b):
        need = max(self.required, 1)
        state["count"] = state["count"] + 1 if b else 0
        if b and not state["latched"] and state["count"] >= need:
            state["latched"] = True
            return True
        if not b and state["latched"]:
            state["latched"] = False
            return False
        return None


class PublishStep(Step):
    """What a policy that compares with the last published value publishes: (value held, whether it was published)."""

    def __init__(self, policy, initial=None):
        self.policy, self.initial = policy, initial

    def start(self):
        return {"held": self.initial, "any": False}

    def step(self, state, x):
        tick = not state["any"] or not self.policy.equal(state["held"], x)
        if tick:
            state["held"], state["any"] = x, True
        return state["held"], tick


class FeedbackStep(Step):
    """An output that is an input one cycle later: y[i] = fn(x[i], y[i - 1])."""

    def __init__(self, fn, initial=0.0):
        self.fn, self.initial = fn, initial

    def start(self):
        return {"last": self.initial}

    def step(self, state, x):
        state["last"] = self.fn(x, state["last"])
        return state["last"]
