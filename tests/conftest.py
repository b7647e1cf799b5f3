import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TIDEMARK_DRIVER_MEMORY", "6g")
    session = local_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Build (series_id, ts, value) from {name: values or {date: value}}."""
    def build(data, start=date(2020, 1, 1)):
        rows = []
        for name, values in data.items():
            items = values.items() if isinstance(values, dict) else ((start + timedelta(days=i), v) for i, v in enumerate(values))
            rows += [(name, d, None if v is None else float(v)) for d, v in items]
        return spark.createDataFrame(rows, "series_id string, ts date, value double")
    return build


@pytest.fixture(scope="session")
def rows():
    def collect(df, *order):
        return [r.asDict(True) for r in (df.orderBy(*order) if order else df).collect()]
    return collect
