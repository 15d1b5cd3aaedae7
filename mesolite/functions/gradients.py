"""Colour gradients as column expressions of t in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))


def _ramp(t: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - lo) / (hi - lo)))


def grayscale(t: Column) -> Column:
    return rgb(t, t, t)


def hot(t: Column) -> Column:
    """Black, red, yellow, white at 0, 3/8, 6/8 and 1."""
    return rgb(_ramp(t, 0, 0.375), _ramp(t, 0.375, 0.75), _ramp(t, 0.75, 1.0))


def jet(t: Column) -> Column:
    tri = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.5) - F.abs(t * 4 - c)))
    return rgb(tri(3.0), tri(2.0), tri(1.0))


def blue_white_red(t: Column) -> Column:
    return rgb(_ramp(t, 0, 0.5), F.when(t <= 0.5, t * 2).otherwise((1 - t) * 2), 1 - _ramp(t, 0.5, 1.0))


def rainbow(t: Column) -> Column:
    """Hues from 0.7 down to 0 at full saturation and value."""
    h = (1 - t) * 0.7 * 6
    part = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.pmod(h + n, F.lit(6.0)), F.lit(4.0) - F.pmod(h + n, F.lit(6.0)))))
    return rgb(1 - part(5.0), 1 - part(3.0), 1 - part(1.0))


def table(colors: list[tuple[float, float, float]]):
    """Linear interpolation in a table of colours."""

    def gradient(t: Column) -> Column:
        n = len(colors) - 1
        at = F.least(F.floor(t * n).cast("int"), F.lit(max(n - 1, 0)))
        part = t * n - at
        cols = []
        for c in range(3):
            values = F.array(*[F.lit(float(x[c])) for x in colors])
            cols.append(F.element_at(values, at + 1) * (1 - part) + F.element_at(values, F.least(at + 2, F.lit(n + 1))) * part)
        return rgb(*cols)

    return gradient


#: Anchor colours of the two perceptual maps at equal distances.
VIRIDIS = [(0.267, 0.005, 0.329), (0.283, 0.141, 0.458), (0.254, 0.265, 0.530), (0.207, 0.372, 0.553), (0.164, 0.471, 0.558), (0.128, 0.567, 0.551), (0.135, 0.659, 0.518), (0.267, 0.749, 0.441), (0.478, 0.821, 0.318), (0.741, 0.873, 0.150), (0.993, 0.906, 0.144)]
MAGMA = [(0.001, 0.000, 0.014), (0.079, 0.054, 0.212), (0.232, 0.060, 0.438), (0.390, 0.100, 0.502), (0.550, 0.161, 0.506), (0.716, 0.215, 0.475), (0.868, 0.288, 0.409), (0.967, 0.440, 0.360), (0.994, 0.624, 0.427), (0.996, 0.813, 0.573), (0.987, 0.991, 0.750)]

GRADIENTS = {"grayscale": grayscale, "hot": hot, "jet": jet, "blue_white_red": blue_white_red, "rainbow": rainbow, "viridis": table(VIRIDIS), "magma": table(MAGMA)}
