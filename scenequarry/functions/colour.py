"""Colour conversions as column expressions, in doubles (8-bit libraries round per step, so levels may differ by 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def _linear(channel: Column) -> Column:
    c = channel / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of sRGB (D65), scaled as 8-bit images store it: L to 0..255, a and b around 128."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    lightness = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return lightness * 255 / 100, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128


def with_value(r: Column, g: Column, b: Column, value: Column) -> tuple[Column, Column, Column]:
    """The colour with its HSV brightness replaced; at fixed hue and saturation RGB is proportional to it."""
    top = F.greatest(r, g, b)
    return tuple(F.when(top > 0, c * value / top).otherwise(value) for c in (r, g, b))
