"""Arithmetic as IEEE 754 has it, where Spark SQL raises errors, gives NULL or ranks NaN above everything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(f"`{x}`") if isinstance(x, str) else F.lit(x)


def div(a, b) -> Column:
    """a / b; a / 0 is an infinity or NaN, by the signs of both."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def ln(a) -> Column:
    """Natural logarithm: -inf at 0, NaN below it and for NaN."""
    a = col(a)
    return F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(F.ln(a))


def pow(a, b) -> Column:
    """a to the power b; 1 to any power and -1 to an infinite one are 1, where Java has NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    one = ((a == 1) & b.isNotNull()) | ((a == -1) & (F.abs(b) == INF))
    return F.when(one, F.lit(1.0)).otherwise(F.pow(a, b))


def _ordered(test: Column, *xs: Column) -> Column:
    for x in xs:
        test = test & ~F.isnan(x)
    return test


def lt(a, b) -> Column:
    a, b = col(a).cast("double"), col(b).cast("double")
    return _ordered(a < b, a, b)


def gt(a, b) -> Column:
    return lt(b, a)


def ge(a, b) -> Column:
    a, b = col(a).cast("double"), col(b).cast("double")
    return _ordered(a >= b, a, b)


def zmul(p, a) -> Column:
    """p * a for chain rules: zero if either is, even against inf or NaN."""
    p, a = col(p), col(a)
    return F.when((p == 0) | (a == 0), F.lit(0.0)).otherwise(p * a)


def differs(a: Column, b: Column) -> Column:
    """Whether a value counts as changed from an earlier one: NaN always does, null equals null."""
    return F.coalesce(F.isnan(a), F.lit(False)) | ~a.eqNullSafe(b)


def let(x: Column, fn) -> Column:
    """fn(x) with x worked out once, however often fn uses it: big expressions would double at every use."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def erf(x) -> Column:
    """Error function, to about 1e-15: a power series near zero, a continued fraction far from it."""
    return let(col(x).cast("double"), _erf)


def _erf(x: Column) -> Column:
    a = F.abs(x)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("term"), a.alias("sum")),
        lambda s, n: F.struct(
            (s["term"] * a * a * 2.0 / (2.0 * n + 1.0)).alias("term"), (s["sum"] + s["term"] * a * a * 2.0 / (2.0 * n + 1.0)).alias("sum")
        ),
        lambda s: s["sum"] * 1.1283791670955126 * F.exp(-a * a),
    )
    small = F.when(a < 2.5, series).otherwise(1.0 - erfc_tail(a))
    return F.when(F.isnan(x), F.lit(NAN)).when(x < 0, -small).otherwise(small)


def erfc_tail(a: Column) -> Column:
    """erfc for a >= 2.5 by its continued fraction, from the innermost part outwards."""
    depth = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(80))), F.lit(0.0), lambda t, n: (n / 2.0) / (a + t))
    return F.when(a > 27, F.lit(0.0)).otherwise(F.exp(-a * a) * 0.5641895835477563 / (a + depth))


def erfc(x) -> Column:
    return let(col(x).cast("double"), lambda v: F.when(v >= 2.5, erfc_tail(v)).otherwise(1.0 - _erf(v)))
