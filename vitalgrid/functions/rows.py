"""Row expressions: pure Columns, so they stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(x: Column, val: float) -> Column:
    return x / F.lit(val)


def _edges(x: Column, zero: float, inside: Column) -> Column:
    """``inside`` above ``zero``, minus infinity there and NaN below, where Spark's logarithms are NULL."""
    return F.when(x == zero, F.lit(float("-inf"))).when(x < zero, F.lit(float("nan"))).otherwise(inside)


def log(x: Column) -> Column:
    return _edges(x, 0.0, F.log(x))


def log_plus_one(x: Column) -> Column:
    return _edges(x, -1.0, F.log1p(x))


def clip(x: Column, lower: float, upper: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lower))), F.lit(float(upper)))


def clip_by_iqr(x: Column, threshold: float = 20) -> Column:
    return clip(x, -threshold, threshold)


def low_amplitude(x: Column, tolerance: float = 0.1) -> Column:
    return F.when(F.abs(x) < tolerance, x).otherwise(F.lit(0.0))


def high_amplitude(x: Column, tolerance: float = 0.1) -> Column:
    return F.when(F.abs(x) > tolerance, x).otherwise(F.lit(0.0))


def enmo(x: Column, y: Column, z: Column) -> Column:
    """Euclidean norm minus one, not below zero."""
    return F.greatest(F.sqrt(x * x + y * y + z * z) - F.lit(1.0), F.lit(0.0))


def tilt(a: Column, b: Column, c: Column) -> Column:
    """Angle in degrees of axis ``a`` against the plane of the other two."""
    return F.degrees(F.atan2(a, F.sqrt(b * b + c * c)))


def tilt_angles(x: Column, y: Column, z: Column) -> dict[str, Column]:
    return {"angle_x": tilt(x, y, z), "angle_y": tilt(y, x, z), "angle_z": tilt(z, x, y)}


def flat_feature(bin_: Column, channel: Column, channels: int) -> Column:
    """Feature index when channels are laid out next to each other per bin."""
    return (bin_ * F.lit(channels) + channel).cast("long")


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def greatest_of(*cols: Column) -> Column:
    return reduce(lambda a, b: F.greatest(a, b), cols)
