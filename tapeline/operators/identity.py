"""Tickers to the securities that owned them, over validity intervals with inclusive ends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tapeline.schemas import HISTORY

_FAR = "9999-12-31"


def _ends() -> Column:
    return F.coalesce("valid_to", F.lit(_FAR).cast("date"))


def history_problems(history: DataFrame) -> DataFrame:
    """Rows whose interval is inverted, or overlaps the one before it on the same ticker."""
    by = Window.partitionBy("symbol").orderBy("valid_from", _ends())
    seen = history.withColumn("_before", F.lag(_ends()).over(by))
    inverted = _ends() < F.col("valid_from")
    overlap = F.coalesce(F.col("_before") >= F.col("valid_from"), F.lit(False))
    return seen.withColumn("problem", F.when(inverted, "inverted").when(overlap, "overlap")).filter("problem is not null").drop("_before")


def validate_history(history: DataFrame) -> DataFrame:
    """``history`` itself, or ValueError. An action: it looks for the first problem."""
    bad = history_problems(history).take(1)
    if bad:
        raise ValueError(f"symbol history has an {bad[0]['problem']} interval: {bad[0].asDict()}")
    return history


def symbol_history(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """(security_id, symbol, valid_from, valid_to or None) rows as a validated history; a null end is open."""
    return validate_history(spark.createDataFrame(list(rows), StructType.fromDDL(HISTORY)))


def rekey_by_security(df: DataFrame, history: DataFrame, date_col: str = "date", symbol_col: str = "symbol", keep_ticker_as: str | None = "ticker", unmatched: str = "keep") -> DataFrame:
    """``symbol_col`` becomes the id of the security that owned the ticker on the row's date.

    Rows without an owner are kept under their ticker, dropped, or raise an error, as ``unmatched`` says.
    """
    choices = {"keep", "drop", "raise"}
    if unmatched not in choices:
        raise ValueError(f"unmatched: {unmatched!r} is none of {sorted(choices)}")
    h = history.select(F.col("symbol").alias("_h_symbol"), F.col("security_id").alias("_h_id"), F.col("valid_from").alias("_h_from"), _ends().alias("_h_to"))
    owns = (F.col(symbol_col) == F.col("_h_symbol")) & (F.col(date_col).cast("date") >= F.col("_h_from")) & (F.col(date_col).cast("date") <= F.col("_h_to"))
    out = df.join(h, owns, "inner" if unmatched == "drop" else "left")
    if unmatched == "raise":
        owner = F.when(F.col("_h_id").isNull(), F.raise_error(F.lit("a row has no symbol-history interval"))).otherwise(F.col("_h_id"))
    else:
        owner = F.coalesce("_h_id", F.col(symbol_col))
    columns = [owner.alias(c) if c == symbol_col else F.col(symbol_col).alias(c) if c == keep_ticker_as else F.col(c) for c in df.columns]
    if keep_ticker_as and keep_ticker_as not in df.columns:
        columns.append(F.col(symbol_col).alias(keep_ticker_as))
    return out.select(*columns)


def security_bars(bars: DataFrame, history: DataFrame) -> DataFrame:
    """Bars by security id: each ticker's bars within the interval it was owned; tickers never mapped keep their name.

    Where intervals of one id overlap on a date, the interval that began first wins.
    """
    h = history.select(F.col("symbol").alias("_h_symbol"), "security_id", "valid_from", _ends().alias("_to"))
    owned = bars.join(h, (F.col("symbol") == F.col("_h_symbol")) & F.col("date").between(F.col("valid_from"), F.col("_to")))
    first = Window.partitionBy("security_id", "date").orderBy("valid_from", "symbol")
    rest = [c for c in bars.columns if c != "symbol"]
    mapped = owned.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(F.col("security_id").alias("symbol"), *rest)
    free = bars.join(history.select("symbol").distinct(), "symbol", "left_anti").select("symbol", *rest)
    return mapped.unionByName(free)
