import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vitalgrid.session import local_session

    s = local_session("tests", cores="8", partitions=4)
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """Samples of one or more channels from Python lists."""
    import pandas as pd

    def make(**channels):
        rows = [
            (name, 0, t, None if v is None else float(v)) for name, values in channels.items() for t, v in enumerate(values)
        ]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["record", "channel", "t", "value"])).selectExpr(
            "record", "cast(channel as int) channel", "t", "value"
        )

    return make


@pytest.fixture
def ordered():
    """Values of one record in time order."""

    def get(df, record="a", column="value", t="t"):
        rows = df.where(df["record"] == record).select(t, column).collect()
        return [r[1] for r in sorted(rows, key=lambda r: r[0])]

    return get
