import pytest

from barloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars of one or more symbols from lists of closes; day i is 2020-01-01 + i."""
    import datetime

    def make(series: dict, spread: float = 1.0, volume: float = 100.0):
        rows = []
        for symbol, closes in series.items():
            for i, c in enumerate(closes):
                day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
                rows.append((symbol, day, float(c), float(c) + spread, float(c) - spread, float(c), float(volume)))
        return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")
    return make
