"""Column types of the tables, and normalisation of what callers hand in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"
CLAIMS = "symbol string, date date, ratio_from double, ratio_to double, source string, type string"
TRUTH = "symbol string, date date, truth_high double, truth_low double, truth_n bigint"
HISTORY = "security_id string, symbol string, valid_from date, valid_to date"
FACTORS = "symbol string, date date, price_factor double, volume_factor double"


def normalise_claims(claims: DataFrame) -> DataFrame:
    """Ratios as doubles, dates as dates, null ``source`` and ``type`` where missing, and a ``rid`` for each row.

    ``rid`` breaks ties (smaller first); callers who care for the input's order supply it.
    """
    out = claims.withColumns({"date": F.col("date").cast("date"), "ratio_from": F.col("ratio_from").cast("double"), "ratio_to": F.col("ratio_to").cast("double")})
    for c in ("source", "type"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    if "rid" not in out.columns:
        out = out.withColumn("rid", F.monotonically_increasing_id())
    return out


def close_series(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"))


def last_bar_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("last_bar"))
