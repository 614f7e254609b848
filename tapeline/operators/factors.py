"""Cumulative factors and adjusted bars of any timeframe and time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType
from pyspark.sql.window import Window, WindowSpec

from tapeline.functions.scratch import few

_EARLIEST = "0001-01-01"


def _later() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)


def implied_events(claims: DataFrame) -> DataFrame:
    """(symbol, date, m): the product of ratio_from / ratio_to of a day's claims, where positive."""
    m = F.try_divide(F.col("ratio_from").cast("double"), F.col("ratio_to").cast("double"))
    return claims.select("symbol", F.col("date").cast("date").alias("date"), m.alias("m")).filter("m > 0").groupBy("symbol", "date").agg(F.product("m").alias("m"))


def _steps(claims: DataFrame) -> DataFrame:
    """(symbol, date, factor): what holds from each event on, and from the earliest date on before the first event.

    Factors multiply from the latest event to the earliest in a window, so their floating-point order is fixed.
    """
    events = implied_events(claims)
    begin = events.select("symbol").distinct().select("symbol", F.lit(_EARLIEST).cast("date").alias("date"), F.lit(1.0).alias("m"))
    return events.unionByName(begin).select("symbol", "date", F.coalesce(F.product("m").over(_later()), F.lit(1.0)).alias("factor"))


def build_factor_table(claims: DataFrame, start_date: str | None = None) -> DataFrame:
    """Sparse factors: a row at each event, and one at ``start_date`` if it lies before the symbol's first event."""
    steps = _steps(claims)
    rows = steps.filter(F.col("date") != F.lit(_EARLIEST).cast("date"))
    if start_date is not None:
        day = F.lit(start_date).cast("date")
        first = rows.groupBy("symbol").agg(F.min("date").alias("first"))
        base = steps.filter(F.col("date") == F.lit(_EARLIEST).cast("date")).join(first, "symbol").filter(day < F.col("first"))
        rows = rows.unionByName(base.select("symbol", day.alias("date"), "factor"))
    return rows.select("symbol", "date", F.col("factor").alias("price_factor"), (1.0 / F.col("factor")).alias("volume_factor"))


def trading_date(df: DataFrame, column: str, exchange_tz: str | Column = "America/New_York", naive_tz: str = "UTC") -> Column:
    """The exchange's calendar date of ``column``: a date as it is, a timestamp in the zone."""
    kind = df.schema[column].dataType
    if isinstance(kind, DateType):
        return F.col(column)
    zone = F.lit(exchange_tz) if isinstance(exchange_tz, str) else exchange_tz
    if isinstance(kind, TimestampNTZType):
        return F.convert_timezone(F.lit(naive_tz), zone, F.col(column)).cast("date")
    return F.convert_timezone(F.current_timezone(), zone, F.col(column).cast("timestamp_ntz")).cast("date")


def zones(spark: SparkSession, tz_by_symbol: dict[str, str] | DataFrame) -> DataFrame:
    """(symbol, zone), one row for each symbol."""
    rows = spark.createDataFrame(list(tz_by_symbol.items()), "symbol string, zone string") if isinstance(tz_by_symbol, dict) else tz_by_symbol
    return rows.select("symbol", "zone").dropDuplicates(["symbol"])


def apply_adjustment(bars: DataFrame, claims: DataFrame, timestamp_col: str = "date", exchange_tz: str = "America/New_York", tz_by_symbol: dict[str, str] | DataFrame | None = None, naive_tz: str = "UTC") -> DataFrame:
    """Adds price_factor, volume_factor and adjusted columns. A bar on an event's date is already on the new basis.

    A symbol's factors are one short sorted array, in which each bar looks its factor up: bars are neither sorted nor, if
    the claims are few enough to be broadcast, shuffled. Beyond that both sides meet in a join by symbol, which can be
    split where one symbol has many bars. ``tz_by_symbol``: a table (symbol, zone), or a dictionary.
    """
    send = F.broadcast if few(claims) else lambda df: df
    zone: str | Column = exchange_tz
    dated = bars
    if tz_by_symbol is not None:
        own = zones(bars.sparkSession, tz_by_symbol).withColumnRenamed("zone", "_zone")
        dated = bars.join(F.broadcast(own) if few(own) else own, "symbol", "left").select(*bars.columns, "_zone")
        zone = F.coalesce("_zone", F.lit(exchange_tz))
    # a bar without a trading date counts as before every event
    dated = dated.withColumn("_day", F.coalesce(trading_date(dated, timestamp_col, zone, naive_tz), F.lit(_EARLIEST).cast("date")))
    arrays = _steps(claims).groupBy(F.col("symbol").alias("_symbol")).agg(F.sort_array(F.collect_list(F.struct("date", "factor"))).alias("_steps"))
    found = dated.join(send(arrays), F.col("symbol") == F.col("_symbol"), "left")
    at = F.element_at(F.filter("_steps", lambda x: x["date"] <= F.col("_day")), -1)
    factor = F.coalesce(at["factor"], F.lit(1.0))
    out = found.withColumns({"price_factor": factor}).withColumn("volume_factor", 1.0 / F.col("price_factor"))
    for c in ("open", "high", "low", "close"):
        if c in bars.columns:
            out = out.withColumn(f"adj_{c}", F.col(c) * F.col("price_factor"))
    if "volume" in bars.columns:
        out = out.withColumn("adj_volume", F.col("volume") * F.col("volume_factor"))
    return out.drop("_day", "_symbol", "_steps", "_zone")
