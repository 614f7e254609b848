"""Row-local operators on streams: the same functions, with static evidence tables joined in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators.guard import guard_bars
from tapeline.operators.identity import rekey_by_security
from tapeline.settings import GuardSettings


def guard_stream(bars: DataFrame, truth: DataFrame | None = None, s: GuardSettings = GuardSettings()) -> DataFrame:
    """Repairs bars as they arrive (stream-static join with ``truth``)."""
    return guard_bars(bars, truth, s)


def rekey_stream(rows: DataFrame, history: DataFrame) -> DataFrame:
    return rekey_by_security(rows, history)


def truth_stream(ticks: DataFrame, ts: str = "ts", price: str = "price", lateness: str = "1 day") -> DataFrame:
    """Daily extremes of a tick stream; a day is final once the watermark has passed it."""
    day = F.window(ts, "1 day")
    daily = ticks.withWatermark(ts, lateness).groupBy("symbol", day).agg(F.max(price).alias("truth_high"), F.min(price).alias("truth_low"), F.count("*").alias("truth_n"))
    return daily.select("symbol", F.to_date("window.start").alias("date"), "truth_high", "truth_low", "truth_n")
