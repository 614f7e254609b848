"""Small tapes for tests: runs of closes on consecutive days."""

import datetime as dt

D0 = dt.date(2023, 1, 2)


def day(n: int) -> dt.date:
    return D0 + dt.timedelta(days=n)


def bars(spark, *series: tuple[str, list[float]], start: int = 0):
    rows = [(s, day(start + i), c, c * 1.01, c * 0.99, c, 1000) for s, closes in series for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume bigint")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
