"""Dual numbers over columns: one run of a user function gives its value and all its partial derivatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee, scalar


class Dual:
    """A value and its derivatives by some variables; comparisons are of values and go into where()."""

    def __init__(self, value, slopes: list[Column]):
        self.value, self.slopes = ieee.col(value), slopes

    def chain(self, value: Column, slope: Column) -> Dual:
        """f(self), given f and f' here."""
        return Dual(value, [ieee.zmul(slope, d) for d in self.slopes])

    def _with(self, other, value, by_self, by_other) -> Dual:
        if not isinstance(other, Dual):
            return self.chain(value, by_self)
        return Dual(value, [ieee.zmul(by_self, a) + ieee.zmul(by_other, b) for a, b in zip(self.slopes, other.slopes, strict=True)])

    def __add__(self, o):
        return self._with(o, self.value + value(o), F.lit(1.0), F.lit(1.0))

    __radd__ = __add__

    def __sub__(self, o):
        return self._with(o, self.value - value(o), F.lit(1.0), F.lit(-1.0))

    def __rsub__(self, o):
        return self.chain(value(o) - self.value, F.lit(-1.0))

    def __mul__(self, o):
        return self._with(o, self.value * value(o), value(o), self.value)

    __rmul__ = __mul__

    def __truediv__(self, o):
        by = scalar.DIVIDE.partials(self.value, value(o))
        return self._with(o, ieee.div(self.value, value(o)), *by)

    def __rtruediv__(self, o):
        return self.chain(ieee.div(value(o), self.value), scalar.DIVIDE.partials(value(o), self.value)[1])

    def __neg__(self):
        return self.chain(-self.value, F.lit(-1.0))

    def __pos__(self):
        return self

    def __lt__(self, o):
        return ieee.lt(self.value, value(o))

    def __gt__(self, o):
        return ieee.gt(self.value, value(o))

    def __le__(self, o):
        return ieee.ge(value(o), self.value)

    def __ge__(self, o):
        return ieee.ge(self.value, value(o))


def value(x) -> Column:
    return x.value if isinstance(x, Dual) else ieee.col(x)


def _unary(op: scalar.Op) -> Callable:
    def f(x):
        return x.chain(op.value(x.value), op.partials(x.value)[0]) if isinstance(x, Dual) else op.value(ieee.col(x))

    return f


exp, log, sqrt = _unary(scalar.EXP), _unary(scalar.LN), _unary(scalar.SQRT)
sin, cos, tan = _unary(scalar.SIN), _unary(scalar.COS), _unary(scalar.TAN)
asin, acos, atan = _unary(scalar.ASIN), _unary(scalar.ACOS), _unary(scalar.ATAN)
tanh = _unary(scalar.Op(F.tanh, lambda a: [ieee.div(ieee.div(1.0, F.cosh(a)), F.cosh(a))]))
erf = _unary(scalar.Op(ieee.erf, lambda a: [1.1283791670955126 * F.exp(-a * a)]))
erfc = _unary(scalar.Op(ieee.erfc, lambda a: [-1.1283791670955126 * F.exp(-a * a)]))
abs = _unary(scalar.Op(F.abs, lambda a: [F.when(ieee.gt(a, 0.0), 1.0).when(ieee.lt(a, 0.0), -1.0).otherwise(0.0)]))


def _binary(op: scalar.Op) -> Callable:
    def f(a, b):
        by = op.partials(value(a), value(b))
        result = op.value(value(a), value(b))
        if isinstance(a, Dual):
            return a._with(b, result, *by)
        return b.chain(result, by[1]) if isinstance(b, Dual) else result

    return f


pow, atan2 = _binary(scalar.POWER), _binary(scalar.ATAN2)


def where(test: Column, a, b):
    """The value and derivatives of the branch taken."""
    if not isinstance(a, Dual) and not isinstance(b, Dual):
        return F.when(test, value(a)).otherwise(value(b))
    n = len((a if isinstance(a, Dual) else b).slopes)
    left, right = [x.slopes if isinstance(x, Dual) else [F.lit(0.0)] * n for x in (a, b)]
    return Dual(F.when(test, value(a)).otherwise(value(b)), [F.when(test, p).otherwise(q) for p, q in zip(left, right, strict=True)])


def min(a, b):
    """The lesser; the first on ties."""
    return where(ieee.lt(value(b), value(a)), b, a)


def max(a, b):
    """The greater; the first on ties."""
    return where(ieee.gt(value(b), value(a)), b, a)


def partials_of(fn: Callable, *inputs: Column) -> tuple[Column, list[Column]]:
    """fn's value and its partial derivatives by each input."""
    n = len(inputs)
    result = fn(*[Dual(x, [F.lit(1.0 if i == k else 0.0) for k in range(n)]) for i, x in enumerate(inputs)])
    return (result.value, result.slopes) if isinstance(result, Dual) else (value(result), [F.lit(0.0)] * n)
