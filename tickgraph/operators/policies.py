"""When a value counts as equal to the one last published."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


class Policy:
    """equal(a, b): whether b need not be published after a. greedy: it compares with the last published value."""

    greedy = False
    always = False

    def equal(self, a, b) -> bool:
        raise NotImplementedError


class AlwaysChanged(Policy):
    always = True

    def equal(self, a, b) -> bool:
        return False


class TypedEquality(Policy):
    """Equal values of one type; null equals null; NaN equals nothing."""

    def equal(self, a, b) -> bool:
        return type(a) is type(b) and a == b


@dataclass(frozen=True)
class Epsilon(Policy):
    """Closer than eps to the last published value; null is always a change."""

    eps: float
    greedy = True

    def equal(self, a, b) -> bool:
        return a is not None and b is not None and abs(a - b) < self.eps


@dataclass(frozen=True)
class Predicate(Policy):
    """As a user function says."""

    fn: Callable
    greedy = True

    def equal(self, a, b) -> bool:
        return bool(self.fn(a, b))
