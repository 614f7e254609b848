"""Repair of impossible and unconfirmed prices in daily bars, from sub-daily evidence where there is any.

Row-local after one join by (symbol, date), so it runs unchanged on a stream.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.settings import GuardSettings

_ADDED = ("_th", "_tl", "_tn", "_usable", "_open", "_open_seen", "_top", "_bottom", "_high", "_low", "_truth", "_kept", "_new_high", "_new_low", "_changed")


def truth_from_ticks(ticks: DataFrame, ts: str = "ts", price: str = "price") -> DataFrame:
    """Daily extremes of a sub-daily record."""
    return ticks.groupBy("symbol", F.to_date(ts).alias("date")).agg(F.max(price).alias("truth_high"), F.min(price).alias("truth_low"), F.count("*").alias("truth_n"))


def _yes(c: Column) -> Column:
    """Null counts as no: missing evidence must not suppress a repair."""
    return F.coalesce(c, F.lit(False))


def guard_bars(bars: DataFrame, truth: DataFrame | None = None, s: GuardSettings = GuardSettings()) -> DataFrame:
    """``bars`` with open, high and low repaired, and bad_print_flag, repair_source and confirmed_extreme."""
    if truth is None:
        df = bars.withColumns({"_th": F.lit(None).cast("double"), "_tl": F.lit(None).cast("double"), "_tn": F.lit(0).cast("bigint")})
    else:
        t = truth.select("symbol", "date", F.col("truth_high").alias("_th"), F.col("truth_low").alias("_tl"), F.coalesce(F.col("truth_n"), F.lit(0)).alias("_tn"))
        df = bars.join(t, ["symbol", "date"], "left")
    o, h, lo, c, th, tl = (F.col(x) for x in ("open", "high", "low", "close", "_th", "_tl"))
    near = 1 + s.confirm_tol
    within = lambda x: (x >= tl * (1 - s.confirm_tol)) & (x <= th * near)
    usable = _yes((tl > 0) & (th >= tl) & (c > 0) & within(c))
    far_open = _yes((c > 0) & ((o > s.band_high * c) | (o < s.band_low * c)))
    df = df.withColumn("_usable", usable)
    seen = F.col("_usable") & _yes(within(o))
    df = df.withColumns({"_open": F.when(far_open & ~seen, c).otherwise(o), "_open_seen": far_open & seen})
    df = df.withColumns({"_top": F.greatest("_open", "close"), "_bottom": F.least("_open", "close")})
    top, bottom, ok = F.col("_top"), F.col("_bottom"), F.col("_usable")
    # each extreme of the evidence must be sane beside the day's body
    th_ok = ok & _yes((th <= s.truth_sanity_band * top) & (th >= top * (1 - s.confirm_tol)))
    tl_ok = ok & _yes((tl >= bottom / s.truth_sanity_band) & (tl <= bottom * near))
    broken = _yes((h < top * (1 - s.geometry_tol)) | (lo > bottom * (1 + s.geometry_tol)))
    spread, spread_seen = F.when(lo > 0, h / lo), F.when(tl > 0, th / tl)
    wide = th_ok & tl_ok & _yes((spread > s.range_insanity_ratio) & (spread > s.range_contradiction_mult * spread_seen))
    dense = ok & _yes(F.col("_tn") >= s.dense_min_bars)
    high_far, low_far = _yes((top > 0) & (h > s.band_high * top)), _yes((bottom > 0) & (lo < s.band_low * bottom))
    high_dense = dense & th_ok & _yes(h > (1 + s.dense_exceed_tol) * th)
    low_dense = dense & tl_ok & _yes(lo < (1 - s.dense_exceed_tol) * tl)
    same = lambda x, t: ok & _yes(F.when((x > 0) & (t > 0), F.abs(F.log(x / t)) <= log(near)))
    high_seen, low_seen = same(h, th), same(lo, tl)
    fix_high, fix_low = broken | ((high_far | wide | high_dense) & ~high_seen), broken | ((low_far | wide | low_dense) & ~low_seen)
    df = df.withColumns({
        "_high": F.when(fix_high & th_ok, F.least(th, s.band_high * top)).when(fix_high, top).otherwise(h),
        "_low": F.when(fix_low & tl_ok, F.greatest(tl, s.band_low * bottom)).when(fix_low, bottom).otherwise(lo),
        "_truth": (fix_high & th_ok) | (fix_low & tl_ok),
        "_kept": (((high_far & high_seen) | (low_far & low_seen)) & ~broken) | F.col("_open_seen"),
    })
    df = df.withColumns({"_new_high": F.greatest("_open", "_high", "close"), "_new_low": F.least("_open", "_low", "close")})
    df = df.withColumn("_changed", _yes((F.col("_open") != o) | (F.col("_new_high") != h) | (F.col("_new_low") != lo)))
    source = F.when(F.col("_changed") & F.col("_truth"), "truth").when(F.col("_changed"), "envelope").when(F.col("_kept"), "confirmed")
    df = df.withColumns({"open": F.col("_open"), "high": F.col("_new_high"), "low": F.col("_new_low"), "bad_print_flag": F.col("_changed").cast("int"), "repair_source": source, "confirmed_extreme": F.col("_kept").cast("int")})
    return df.drop(*_ADDED).select(*bars.columns, "bad_print_flag", "repair_source", "confirmed_extreme")
