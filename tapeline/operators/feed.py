"""Is the feed itself wrong: frozen prices, and spans stamped a session early or late."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tapeline.functions.tape import by_date
from tapeline.schemas import close_series
from tapeline.settings import FeedSettings

STALE_FEED, ILLIQUID, UNVERIFIED, DATE_SHIFT = "STALE_FEED", "ILLIQUID", "UNVERIFIED", "DATE_SHIFT"


def _all() -> WindowSpec:
    return Window.partitionBy("symbol")


def _runs(bars: DataFrame) -> DataFrame:
    """symbol, start, end, n_bars, close, before of runs of two equal closes or more; ``before`` is the bar before, if any.

    One sort of the tape: of each run only its first and last bar are kept, and the last looks back at the first.
    """
    close, so_far = F.col("close"), by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    differs = lambda other: F.coalesce(close != other, F.lit(False))
    first = F.row_number().over(by_date()) == 1
    b = close_series(bars).filter("symbol is not null").withColumns({
        "i": F.row_number().over(by_date()), "before": F.lag("date").over(by_date()), "dated": F.first("date", ignorenulls=True).over(so_far),
        "opens": first | differs(F.lag("close").over(by_date())), "closes": F.lead(F.lit(True)).over(by_date()).isNull() | differs(F.lead("close").over(by_date())),
    })
    ends = b.filter("opens != closes").withColumn("o", F.lag(F.struct("date", "i", "close", "before")).over(by_date())).filter("closes")
    # dates that are missing come first
    start = F.coalesce("o.date", "dated")
    return ends.select("symbol", start.alias("start"), F.col("date").alias("end"), (F.col("i") - F.col("o.i") + 1).cast("bigint").alias("n_bars"), F.col("o.close").alias("close"), F.coalesce("o.before", start).alias("before"))


def _seen(found: DataFrame, witness: DataFrame) -> DataFrame:
    """``found`` with the witness's last closes up to ``before`` and ``end`` (``b``, ``e``) and its range within the run.

    One sort of the witness with three points a run: a witness bar is after the start of its day and before the rest.
    """
    start, bar, before, end = range(4)
    point = lambda c, k: F.struct(F.col(c).alias("t"), F.lit(k).alias("k"))
    run = F.struct("start", "end", "n_bars", "close").alias("run")
    asked = found.select("symbol", run, F.explode(F.array(point("start", start), point("before", before), point("end", end))).alias("p")).select("symbol", "p.t", "p.k", "run")
    told = close_series(witness).filter("date is not null").select("symbol", F.col("date").alias("t"), F.lit(bar).alias("k"), F.col("close").alias("w"))
    so_far = Window.partitionBy("symbol").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.col("k")
    both = asked.unionByName(told, allowMissingColumns=True).withColumns({
        "at": F.last(F.when(k == bar, F.struct("w")), ignorenulls=True).over(so_far), "own": F.last(F.when(k == start, F.col("run")), ignorenulls=True).over(so_far),
    })
    of_run = both.withColumn("run", F.when(k == bar, F.col("own")).otherwise(F.col("run"))).filter((k != bar) | (F.col("t") <= F.col("run.end")))
    at = lambda p: F.max(F.when((k == p) & F.col("t").isNotNull(), F.col("at.w")))
    return of_run.groupBy("symbol", F.col("run.start").alias("start"), F.col("run.end").alias("end"), F.col("run.n_bars").alias("n_bars")).agg(
        F.first("run.close").alias("close"), at(before).alias("b"), at(end).alias("e"), F.max("w").alias("top"), F.min("w").alias("low")
    )


def stale_runs(bars: DataFrame, witness: DataFrame | None = None, s: FeedSettings = FeedSettings()) -> DataFrame:
    """symbol, start, end, n_bars, close, witness_move, classification of runs of equal closes beyond the symbol's norm."""
    # the quantile is a place in the sorted lengths; a run is as long if so many are no longer than it
    up_to, runs = F.count("*").over(_all().orderBy("n_bars")), F.count("*").over(_all())
    place = F.least(F.col("runs") - 1, F.floor(F.lit(s.own_run_quantile) * F.col("runs"))) + 1
    long = (F.col("runs") < s.least_runs_for_quantile) | (F.col("up_to") >= place)
    found = _runs(bars).withColumns({"up_to": up_to, "runs": runs}).filter(long & (F.col("n_bars") >= s.min_stale_run))
    if witness is None:
        return found.select("symbol", "start", "end", "n_bars", "close", F.lit(None).cast("double").alias("witness_move"), F.lit(UNVERIFIED).alias("classification"))
    seen = _seen(found, witness)
    known = (F.col("b") > 0) & (F.col("e") > 0)
    move = F.when(known, F.log(F.col("e") / F.col("b")))
    moved = (F.abs(move) > s.witness_move_ln) | F.coalesce((F.col("low") > 0) & (F.col("top") / F.when(F.col("low") > 0, F.col("low")) > exp(s.witness_move_ln)), F.lit(False))
    kind = F.when(move.isNull(), UNVERIFIED).when(moved, STALE_FEED).otherwise(ILLIQUID)
    return seen.select("symbol", "start", "end", "n_bars", "close", move.alias("witness_move"), kind.alias("classification"))


def date_shifts(bars: DataFrame, witness: DataFrame, s: FeedSettings = FeedSettings()) -> DataFrame:
    """Spans that fit the witness better one session off: shift +1 is stamped late, -1 early."""
    n = s.shift_window
    side = lambda df, name: close_series(df).withColumnRenamed("close", name)
    j = side(bars, "p").join(side(witness, "w"), ["symbol", "date"]).filter("p > 0 and w > 0")
    # fewer common days than a window and its neighbours need give no error anyway: the first window ends at row n
    j = j.withColumns({"rp": F.log(F.col("p") / F.lag("p").over(by_date())), "rw": F.log(F.col("w") / F.lag("w").over(by_date()))})
    j = j.withColumns({"rw_prev": F.lag("rw").over(by_date()), "rw_next": F.lead("rw").over(by_date())}).dropna(subset=["rp", "rw", "rw_prev", "rw_next"])
    frame = by_date().rowsBetween(-(n - 1), 0)
    error = lambda c: F.avg(F.abs(F.col("rp") - F.col(c))).over(frame)
    j = j.withColumns({"e0": error("rw"), "ep": error("rw_prev"), "em": error("rw_next"), "i": F.row_number().over(by_date())}).filter(F.col("i") >= n)
    best = F.least("ep", "em")
    flag = F.when((F.col("e0") > s.shift_min_error_ln) & (best < s.shift_improvement * F.col("e0")), F.when(F.col("ep") <= F.col("em"), 1).otherwise(-1)).otherwise(0)
    j = j.withColumns({"shift": flag, "best": best, "k": F.col("i") - n})
    # a span starts n - 1 rows, of those that have an error, before its first flag
    j = j.withColumns({"from": F.lag("date", n - 1).over(by_date()), "first": F.first("date").over(by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    turn = F.coalesce((F.col("shift") != F.lag("shift").over(by_date())).cast("int"), F.lit(0))
    j = j.withColumn("turn", turn).withColumn("span", F.sum("turn").over(by_date())).filter("shift != 0")
    spans = j.groupBy("symbol", "span", "shift").agg(
        F.min_by(F.coalesce("from", "first"), "date").alias("start"), F.max("date").alias("end"), (F.max("k") - F.min("k") + n).cast("bigint").alias("n_sessions"),
        F.max("e0").alias("aligned_error"), F.min("best").alias("shifted_error"),
    )
    return spans.select("symbol", "start", "end", "n_sessions", F.col("shift").cast("bigint").alias("shift"), "aligned_error", "shifted_error", F.lit(DATE_SHIFT).alias("classification"))
