"""What the price tape says: gaps across dates, one-day moves, unique boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tapeline.functions.scratch import few, materialize
from tapeline.schemas import close_series
from tapeline.settings import ChainSettings


def by_date() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def implied_ln(ratio_from: str = "ratio_from", ratio_to: str = "ratio_to") -> Column:
    """ln(ratio_from / ratio_to), null unless both are positive."""
    a, b = F.col(ratio_from), F.col(ratio_to)
    return F.when((a > 0) & (b > 0), F.log(a / b))


def middle(values: Column) -> Column:
    """Median of a non-empty array: the mean of the middle pair if the length is even; null for an empty one."""
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def upper_median(values: Column) -> Column:
    s = F.sort_array(values)
    return F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def bars_with_neighbours(bars: DataFrame, k: int = 3) -> DataFrame:
    """Each bar with the closes of the ``k`` bars up to it (``back``) and from it on (``ahead``)."""
    back, ahead = by_date().rowsBetween(-(k - 1), 0), by_date().rowsBetween(0, k - 1)
    return close_series(bars).select("symbol", "date", F.collect_list("close").over(back).alias("back"), F.collect_list("close").over(ahead).alias("ahead"))


def local_tape(claims: DataFrame, bars: DataFrame, reach: int = 96, core: int = 32, least: int = 3) -> DataFrame:
    """The bars that stages of the chain can look at: those within ``reach`` days of a claim of their symbol.

    Where fewer than ``least`` of them lie beyond ``core`` days on a side of a claim, neighbours may be further away, so
    that symbol's whole tape is taken. The tape is filtered by a join with the claims' (symbol, block of days), and by
    another with the sparse symbols; it is not sorted. The claims' blocks are only broadcast if they are few.
    """
    block = lambda c: F.floor(F.unix_date(c) / 32)
    dated = claims.select("rid", "symbol", F.col("date").cast("date").alias("day")).filter("day is not null")
    blocks = dated.select("symbol", F.explode(F.sequence(block(F.date_sub("day", reach)), block(F.date_add("day", reach)))).alias("block")).distinct()
    send = F.broadcast if few(blocks) else lambda df: df
    tape = close_series(bars)
    near = materialize(tape.withColumn("block", block("date")).join(send(blocks), ["symbol", "block"], "left_semi").select("symbol", "date", "close"))
    off = F.datediff("date", "day")
    seen = dated.join(near, "symbol", "left").groupBy("rid", "symbol").agg(F.count_if(off.between(-reach, -core - 1)).alias("before"), F.count_if(off.between(core + 1, reach)).alias("after"))
    sparse = materialize(seen.filter((F.col("before") < least) | (F.col("after") < least)).select("symbol").distinct())
    return near.join(sparse, "symbol", "left_anti").unionByName(tape.join(send(sparse), "symbol", "left_semi"))


def with_gap(ranges: DataFrame, bars: DataFrame, max_gap_days: int = 10, name: str = "gap") -> DataFrame:
    """``ranges`` (symbol, first, last and more; unique ``rid``) with the measured close ratio across [first, last].

    Medians of up to three closes strictly after ``last`` and strictly before ``first``; null if a side is empty, more
    than ``max_gap_days`` away or not positive. ``bars`` come from ``bars_with_neighbours``, best of a ``local_tape``. Only
    bars within those days can count, so ranges meet them by symbol and block of days.
    """
    sides = F.array(
        F.struct(F.lit(True).alias("before"), F.date_sub("first", max_gap_days).alias("lo"), F.date_sub("first", 1).alias("hi")),
        F.struct(F.lit(False).alias("before"), F.date_add("last", 1).alias("lo"), F.date_add("last", max_gap_days).alias("hi")),
    )
    block = lambda c: F.floor(F.unix_date(c) / 16)
    asked = ranges.select("rid", "symbol", F.explode(sides).alias("e")).select("rid", "symbol", "e.*").withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    told = bars.select("symbol", block("date").alias("block"), "date", "back", "ahead")
    met = asked.join(told, ["symbol", "block"]).filter(F.col("date").between(F.col("lo"), F.col("hi")))
    sides = met.groupBy("rid").agg(F.max_by("back", F.when(F.col("before"), F.col("date"))).alias("back"), F.min_by("ahead", F.when(~F.col("before"), F.col("date"))).alias("ahead"))
    b, a = middle(F.col("back")), middle(F.col("ahead"))
    return ranges.join(sides, "rid", "left").withColumn(name, F.when((b > 0) & (a > 0), a / b)).drop("back", "ahead")


def with_own_gap(claims: DataFrame, bars: DataFrame, max_gap_days: int = 10) -> DataFrame:
    """Claims with the gap at their own date."""
    return with_gap(claims.withColumns({"first": F.col("date"), "last": F.col("date")}), bars, max_gap_days).drop("first", "last")


def unique_boundaries(claims: DataFrame, bars: DataFrame, s: ChainSettings = ChainSettings()) -> DataFrame:
    """(rid, tape_date, measured_1d) for claims with exactly one matching and lasting one-day move near their date."""
    close, one = F.col("close"), F.lag("close").over(by_date())
    moves = close_series(bars).withColumns({"prev": one, "next": F.lead("close").over(by_date()), "before": F.lag("date", 2).over(by_date()), "after": F.lead("date", 2).over(by_date())})
    ratio = F.when((F.col("prev") > 0) & (close > 0), close / F.col("prev"))
    ratio_next = F.when((close > 0) & (F.col("next") > 0), F.col("next") / close)
    # a symbol has three bars if one of them has two on a side or one on both
    three = F.col("before").isNotNull() | F.col("after").isNotNull() | (F.col("prev").isNotNull() & F.col("next").isNotNull())
    moves = moves.filter(three).select("symbol", F.col("date").alias("tape_date"), ratio.alias("r"), ratio_next.alias("r_next"), F.floor(F.unix_date("date") / 32).alias("bucket")).filter("r is not null")
    lo, hi = F.date_sub("date", s.snap_back_days), F.date_add("date", s.snap_fwd_days)
    asked = claims.select("rid", "symbol", lo.alias("lo"), hi.alias("hi"), implied_ln().alias("implied")).filter("implied is not null")
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.unix_date("lo") / 32), F.floor(F.unix_date("hi") / 32))))
    match = asked.join(moves, ["symbol", "bucket"]).filter(F.col("tape_date").between(F.col("lo"), F.col("hi")) & (F.abs(F.log("r") - F.col("implied")) < s.snap_tolerance_ln))
    only = match.groupBy("rid").agg(F.count("*").alias("n"), F.first("tape_date").alias("tape_date"), F.first("r").alias("r"), F.first("r_next").alias("r_next"), F.first("implied").alias("implied"))
    back = F.log("r_next")
    undone = (back * F.col("implied") < 0) & (F.abs(back) > 0.5 * F.abs("implied"))
    return only.filter((F.col("n") == 1) & F.col("r_next").isNotNull() & ~undone).select("rid", "tape_date", F.round("r", 6).alias("measured_1d"))
