"""Angles, directions and circular statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = {"degree": 360.0, "radians": 2 * 3.141592653589793}


def _rad(x: Column, unit: str) -> Column:
    return F.radians(x) if unit == "degree" else x


def angular_distance(x: Column, y: Column, boundary: float = 360.0) -> Column:
    """Signed shortest way from y to x, in [-boundary/2, boundary/2)."""
    turned, full = x - y + F.lit(boundary / 2), F.lit(float(boundary))
    return F.when((turned >= 0) & (turned < full), turned).otherwise(F.pmod(turned, full)) - F.lit(boundary / 2)  # few need a remainder


def circular_mean(x: Column, unit: str = "degree") -> Column:
    """Aggregate: direction of the mean vector, in [0, full circle); nulls are left out."""
    a = F.atan2(F.avg(F.sin(_rad(x, unit))), F.avg(F.cos(_rad(x, unit))))
    return F.pmod(F.degrees(a) if unit == "degree" else a, F.lit(_FULL[unit]))


def circular_std(x: Column, unit: str = "degree") -> Column:
    """Aggregate: sqrt(-2 ln R) of the mean vector's length R, in the unit; nulls are left out."""
    r = F.sqrt(F.pow(F.avg(F.sin(_rad(x, unit))), 2) + F.pow(F.avg(F.cos(_rad(x, unit))), 2))
    s = F.sqrt(-2 * F.log(F.least(r, F.lit(1.0))))
    return F.degrees(s) if unit == "degree" else s


def rotated(x: Column, y: Column, degrees: float | Column) -> tuple[Column, Column]:
    """The point turned counter-clockwise about the origin."""
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def slope_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Slope of the line through two points (infinite if vertical) and its angle in degrees."""
    dx, dy = x2 - x1, y2 - y1
    slope = F.when(dx != 0, F.try_divide(dy, dx)).otherwise(F.when(dy >= 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    return slope, F.when(dx != 0, F.degrees(F.atan(F.try_divide(dy, dx)))).otherwise(F.when(dy >= 0, F.lit(90.0)).otherwise(F.lit(-90.0)))


def triangular_s(x: Column, period: float = 360.0) -> Column:
    """Triangular counterpart of the sine: |s| + |c| = 1."""
    p = F.pmod(x, F.lit(float(period))) / F.lit(period / 4)
    return F.when(p <= 1, p).when(p <= 3, 2 - p).otherwise(p - 4)


def triangular_c(x: Column, period: float = 360.0) -> Column:
    return triangular_s(x + F.lit(period / 4), period)


def from_triangular(s: Column, c: Column, period: float = 360.0) -> Column:
    """The angle whose triangular s and c these are, in [0, period)."""
    quarter = F.lit(period / 4)
    return F.pmod(F.when(s >= 0, (1 - c) * quarter).otherwise(4 * quarter - (1 - c) * quarter), F.lit(float(period)))


def from_sin_cos(s: Column, c: Column) -> Column:
    """The angle in degrees, in [0, 360)."""
    return F.pmod(F.when(s >= 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(c, F.lit(1.0)))))).otherwise(360 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(c, F.lit(1.0)))))), F.lit(360.0))


def wind_vector(direction: Column, speed: Column, kind: str = "trigonometric") -> tuple[Column, Column]:
    """u, v of a direction (degrees) and speed."""
    if kind == "triangular":
        return triangular_s(direction) * speed, triangular_c(direction) * speed
    return F.sin(F.radians(direction)) * speed, F.cos(F.radians(direction)) * speed


def direction_speed(u: Column, v: Column, kind: str = "trigonometric") -> tuple[Column, Column]:
    """Direction (null where the speed is 0) and speed of a vector."""
    speed = F.abs(u) + F.abs(v) if kind == "triangular" else F.sqrt(u * u + v * v)
    s, c = F.try_divide(u, speed), F.try_divide(v, speed)
    return F.when(speed > 0, from_triangular(s, c) if kind == "triangular" else from_sin_cos(s, c)), speed
