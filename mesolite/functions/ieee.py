"""Scalar functions with the semantics of IEEE doubles, as JVM-side columns.

Spark's ``/`` and ``ln`` raise or give NULL where doubles give infinities and
NaN, and Spark's comparisons take NaN for the greatest value and equal to
itself.  Computed properties and selections need the IEEE rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b; x / 0 is infinite, 0 / 0 is NaN (the sign of a zero divisor is not looked at)."""
    a, b = a.cast("double"), b.cast("double")
    safe = F.when(b != 0, b)
    return F.coalesce(a / safe, F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF)))


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; NaN for a zero divisor."""
    safe = F.when(b != 0, b.cast("double"))
    return F.coalesce(a.cast("double") % safe, F.lit(NAN))


def _log(f, x: Column) -> Column:
    x = x.cast("double")
    return F.when(x > 0, f(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def ln(x: Column) -> Column:
    return _log(F.ln, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def rint(x: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(x.cast("double") + 0.5).cast("double")


def _ordered(a: Column, b: Column, result: Column) -> Column:
    return (~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")) & result).cast("double")


def lt(a: Column, b: Column) -> Column:
    return _ordered(a, b, a < b)


def le(a: Column, b: Column) -> Column:
    return _ordered(a, b, a <= b)


def gt(a: Column, b: Column) -> Column:
    return _ordered(a, b, a > b)


def ge(a: Column, b: Column) -> Column:
    return _ordered(a, b, a >= b)


def eq(a: Column, b: Column) -> Column:
    return _ordered(a, b, a == b)


def ne(a: Column, b: Column) -> Column:
    return F.lit(1.0) - eq(a, b)


def truth(x: Column) -> Column:
    """Whether a double counts as true: everything but zero, so NaN too."""
    return x.cast("double") != 0


def both(a: Column, b: Column) -> Column:
    return (truth(a) & truth(b)).cast("double")


def either(a: Column, b: Column) -> Column:
    return (truth(a) | truth(b)).cast("double")


def choose(a: Column, b: Column, c: Column) -> Column:
    return F.when(truth(a), b).otherwise(c)


def least(*x: Column) -> Column:
    return F.least(*x) if len(x) > 1 else x[0]


def greatest(*x: Column) -> Column:
    return F.greatest(*x) if len(x) > 1 else x[0]


def total(*x: Column) -> Column:
    out = x[0]
    for y in x[1:]:
        out = out + y
    return out


def mean(*x: Column) -> Column:
    return total(*x) / float(len(x))


def to_int(x: Column) -> Column:
    """Truncation, clamped to 32 bits; NaN is 0."""
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.least(F.greatest(x, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int"))
