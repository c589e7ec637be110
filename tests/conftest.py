import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 4, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        # Tables of a few rows: compiling code takes longer than running it.
        "spark.sql.codegen.wholeStage": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_bars(spark):
    """Bars of one or more series of closes, one per day."""
    def make(series, start=dt.date(2001, 1, 1)):
        rows = []
        for symbol, closes in series.items():
            for i, c in enumerate(closes):
                rows.append((symbol, start + dt.timedelta(days=i), c * 0.99, c * 1.02, c * 0.97, float(c), 100 + (i * 37) % 50))
        return spark.createDataFrame(
            rows, "symbol string, date date, open double, high double, low double, close double, volume bigint")

    return make


@pytest.fixture
def columns():
    """Rows of a frame as lists per column, ordered by date, for one symbol."""
    def get(df, symbol, *names):
        rows = df.filter(df["symbol"] == symbol).orderBy("date").select(*names).collect()
        return [[r[n] for r in rows] for n in names]

    return get
