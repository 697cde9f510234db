"""Seeded randomness from hashes of row keys.

The same key gives the same draw whatever the partitioning, so a retried task
reproduces its rows and samples can be checked outside Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296.0


def _digest(parts: tuple) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _word(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double")


def uniform(*parts) -> Column:
    """Number in [0, 1) from the key parts joined by ``|``."""
    return _word(_digest(parts), 0) / F.lit(_SPAN)


def normal(*parts, mean=0.0, sigma=1.0) -> Column:
    """Normal draw (Box-Muller on two words of one digest)."""
    digest = _digest(parts)
    u = (_word(digest, 0) + F.lit(0.5)) / F.lit(_SPAN)
    v = _word(digest, 1) / F.lit(_SPAN)
    z = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    return mean + F.lit(float(sigma)) * z


def integer(low: Column, high: Column, *parts) -> Column:
    """Integer in ``[low, high)``; ``low`` when the range is empty."""
    span = F.greatest(high - low, F.lit(0))
    return (low + F.floor(uniform(*parts) * span)).cast("long")
