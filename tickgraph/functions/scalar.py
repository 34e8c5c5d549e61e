"""The scalar operators: value and partial derivatives as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee


@dataclass(frozen=True)
class Op:
    """value(*inputs) and partials(*inputs), one for each input; partials is None for an operator without derivative."""

    value: Callable[..., Column]
    partials: Callable[..., list[Column]] | None = None


def _one() -> Column:
    return F.lit(1.0)


def _product_partials(*xs: Column) -> list[Column]:
    """Products of the others, by prefixes and suffixes, so that zero factors stay exact."""
    before, after = [_one()], [_one()]
    for x in xs[:-1]:
        before.append(before[-1] * x)
    for x in reversed(xs[1:]):
        after.append(after[-1] * x)
    return [b * a for b, a in zip(before, reversed(after), strict=True)]


def _power_partials(a: Column, b: Column) -> list[Column]:
    by_base = F.when(b == 0, F.lit(0.0)).otherwise(b * ieee.pow(a, b - 1))
    by_exponent = F.when((a == 0) & (b > 0), F.lit(0.0)).otherwise(ieee.pow(a, b) * ieee.ln(a))
    return [by_base, by_exponent]


def _atan2_partials(y: Column, x: Column) -> list[Column]:
    h = F.hypot(y, x)
    return [ieee.div(ieee.div(x, h), h), -ieee.div(ieee.div(y, h), h)]


def _arc_slope(a: Column) -> Column:
    return ieee.div(1.0, F.sqrt((1 - a) * (1 + a)))


SUM = Op(lambda *xs: reduce(lambda s, x: s + x, xs, F.lit(0.0)), lambda *xs: [_one() for _ in xs])
PRODUCT = Op(lambda *xs: reduce(lambda s, x: s * x, xs, F.lit(1.0)), _product_partials)
DIFF = Op(lambda a, b: a - b, lambda a, b: [_one(), F.lit(-1.0)])
DIVIDE = Op(ieee.div, lambda a, b: [ieee.div(1.0, b), -ieee.div(ieee.div(a, b), b)])
NEGATE = Op(lambda a: -a, lambda a: [F.lit(-1.0)])
EXP = Op(F.exp, lambda a: [F.exp(a)])
LN = Op(ieee.ln, lambda a: [ieee.div(1.0, a)])
POWER = Op(ieee.pow, _power_partials)
SQRT = Op(F.sqrt, lambda a: [ieee.div(0.5, F.sqrt(a))])
SIN = Op(F.sin, lambda a: [F.cos(a)])
COS = Op(F.cos, lambda a: [-F.sin(a)])
TAN = Op(F.tan, lambda a: [1 + F.tan(a) * F.tan(a)])
ASIN = Op(F.asin, lambda a: [_arc_slope(a)])
ACOS = Op(F.acos, lambda a: [-_arc_slope(a)])
ATAN = Op(F.atan, lambda a: [ieee.div(1.0, 1 + a * a)])
ATAN2 = Op(F.atan2, _atan2_partials)

OPS: dict[str, Op] = {
    "sum": SUM, "product": PRODUCT, "diff": DIFF, "divide": DIVIDE, "negate": NEGATE, "exp": EXP, "ln": LN, "power": POWER,
    "sqrt": SQRT, "sin": SIN, "cos": COS, "tan": TAN, "asin": ASIN, "acos": ACOS, "atan": ATAN, "atan2": ATAN2,
}


def register(name: str, value: Callable[..., Column], partials: Callable[..., list[Column]] | None = None) -> Op:
    """A custom operator; with partials it takes part in derivatives."""
    OPS[name] = Op(value, partials)
    return OPS[name]
