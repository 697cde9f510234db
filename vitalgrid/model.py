"""Table shapes and constants shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

# float64 machine epsilon and the Keras fuzz factor.
EPS = 2.220446049250313e-16
KAPPA = 1e-7

# Samples per chunk of a recording; bounds the memory of one grouped-map call.
CHUNK = 131_072


@dataclass(frozen=True)
class Layout:
    """Column names of a sample table: group keys, sample index and value."""

    keys: tuple[str, ...] = ("record", "channel")
    t: str = "t"
    value: str = "value"


DEFAULT = Layout()


def layout(keys: Sequence[str] = DEFAULT.keys, t: str = "t", value: str = "value") -> Layout:
    return Layout(tuple(keys), t, value)


SAMPLES = T.StructType(
    [
        T.StructField("record", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("t", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)
SIGNAL_META = T.StructType(
    [
        T.StructField("record", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("fs", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)
INTERVALS = T.StructType(
    [
        T.StructField("record", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("duration", T.LongType()),
    ]
)
ANNOTATIONS = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("label", T.StringType()),
    ]
)


def odd_window(fs: float, seconds: float) -> int:
    """Window length in samples, made odd so it has a centre."""
    w = int(round(fs * seconds))
    return w + 1 if w % 2 == 0 else w


def next_power_of_two(n: int) -> int:
    return 1 << (int(n) - 1).bit_length()
