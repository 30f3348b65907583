"""Complex numbers as ``struct<re double, im double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(re: Column | float, im: Column | float) -> Column:
    re = re if isinstance(re, Column) else F.lit(float(re))
    im = im if isinstance(im, Column) else F.lit(float(im))
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def re(z: Column) -> Column:
    return z.getField("re")


def im(z: Column) -> Column:
    return z.getField("im")


def inverse(a: Column, b: Column) -> tuple[Column, Column]:
    """1 / (a + jb)."""
    size = a * a + b * b
    return a / size, -b / size


def power(z: Column, exponent: float) -> Column:
    """Principal branch power in polar form."""
    radius = F.pow(F.hypot(re(z), im(z)), F.lit(float(exponent)))
    angle = F.atan2(im(z), re(z)) * F.lit(float(exponent))
    return make(radius * F.cos(angle), radius * F.sin(angle))


def sqrt_imag(z: Column) -> Column:
    """Imaginary part of the principal square root."""
    return F.sqrt(F.hypot(re(z), im(z))) * F.sin(F.atan2(im(z), re(z)) / F.lit(2.0))


