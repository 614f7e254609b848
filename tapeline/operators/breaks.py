"""Level shifts that no claim explains, and what an independent witness says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.asof import asof
from tapeline.functions.tape import by_date, implied_ln, upper_median
from tapeline.schemas import close_series
from tapeline.settings import BreakSettings

UNEXPLAINED, REAL_MOVE, PROVIDER_BREAK = "UNEXPLAINED", "REAL_MOVE", "PROVIDER_BREAK"


def jump_candidates(bars: DataFrame, claims: DataFrame | None = None, s: BreakSettings = BreakSettings()) -> DataFrame:
    """(symbol, date, prev_date, shift, z, one_day_end): large moves against the symbol's own robust volatility.

    One pass over the tape; the trailing window is only gathered where a move is large.
    """
    close, prev = F.col("close"), F.lag("close").over(by_date())
    tape = close_series(bars)
    b = tape.withColumns({"i": F.row_number().over(by_date()), "prev_date": F.lag("date").over(by_date()), "ret": F.when((close > 0) & (prev > 0), F.log(close / prev))})
    b = b.withColumns({"ret_next": F.lead("ret").over(by_date()), "next_date": F.lead("date").over(by_date())})
    enough = tape.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * s.persist_bars + 2).select("symbol")
    # large moves are few: each fetches its own surroundings by blocks of bars, instead of a trailing list for every bar
    reach = max(s.vol_lookback, s.persist_bars)
    block = lambda c: F.floor(F.col(c) / reach)
    large = b.filter(F.abs("ret") >= s.min_jump_ln).join(enough, "symbol", "left_semi")
    asked = large.select("symbol", F.col("i").alias("at"), F.explode(F.sequence(F.floor((F.col("i") - reach) / reach), F.floor((F.col("i") + s.persist_bars) / reach))).alias("block"))
    told = b.select("symbol", block("i").alias("block"), (F.col("i")).alias("j"), F.col("ret").alias("r"), F.col("close").alias("c"))
    off = F.col("j") - F.col("at")
    around = asked.join(told, ["symbol", "block"]).filter((off >= -reach) & (off < s.persist_bars)).groupBy("symbol", F.col("at").alias("i")).agg(
        F.collect_list(F.when(off.between(-s.vol_lookback, -1), F.col("r"))).alias("trail"),
        F.collect_list(F.when(off.between(-s.persist_bars, -1), F.col("c"))).alias("before"),
        F.collect_list(F.when(off.between(0, s.persist_bars - 1), F.col("c"))).alias("after"),
    )
    b = large.join(around, ["symbol", "i"])
    b = b.withColumn("mid", upper_median(F.col("trail")))
    mad = upper_median(F.transform("trail", lambda x: F.abs(x - F.col("mid"))))
    sigma = F.when((F.size("trail") >= 10) & (mad > 0), 1.4826 * mad)
    b = b.withColumn("z", F.coalesce(F.abs("ret") / sigma, F.lit(float("inf")))).filter(F.col("z") >= s.z_threshold)
    mb, ma = upper_median(F.col("before")), upper_median(F.col("after"))
    b = b.withColumn("level", F.when((mb > 0) & (ma > 0), F.log(ma / mb))).filter("level is not null")
    lasting = F.abs(F.col("level") - F.col("ret")) <= s.persist_tol_ln
    one_day = ~lasting & F.lit(s.report_one_day_windows) & F.coalesce(F.abs(F.col("ret") + F.col("ret_next")) <= s.persist_tol_ln, F.lit(False))
    b = b.filter(lasting | one_day).select("symbol", "date", "prev_date", F.when(lasting, F.col("level")).otherwise(F.col("ret")).alias("shift"), "z", F.when(~lasting, F.col("next_date")).alias("one_day_end"))
    if claims is None:
        return b
    told = claims.select(F.col("symbol").alias("_s"), F.col("date").cast("date").alias("_d"), implied_ln().alias("_m")).filter("_m is not null")
    explains = (F.col("symbol") == F.col("_s")) & F.col("one_day_end").isNull() & (F.abs(F.datediff("date", "_d")) <= s.claim_window_days) & (F.abs(F.col("shift") - F.col("_m")) <= s.claim_tol_ln)
    return b.join(told, explains, "left_anti")


def scan_jumps(bars: DataFrame, claims: DataFrame | None = None, s: BreakSettings = BreakSettings()) -> DataFrame:
    """Unexplained jumps: symbol, date, prev_date, measured_ratio, z_score, reverted_on.

    A lasting jump is paired with the first later unused one that undoes it; both are then one finding. The pairing is
    a fold over a symbol's candidates, which are few beside its bars.
    """
    c = jump_candidates(bars, claims, s)
    rows = F.sort_array(F.collect_list(F.struct("date", "prev_date", "shift", "z", "one_day_end")))
    listed = c.groupBy("symbol").agg(rows.alias("rows")).withColumn("c", F.transform("rows", lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<i:int,reverted:date>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        later = F.filter(F.col("c"), lambda y: (y["i"] > x["i"]) & ~F.array_contains(acc["used"], y["i"]) & (F.datediff(y["x"]["date"], x["x"]["date"]) <= s.revert_window_days) & (F.abs(x["x"]["shift"] + y["x"]["shift"]) <= s.persist_tol_ln))
        one_day = x["x"]["one_day_end"].isNotNull()
        mate = F.when(~one_day, F.try_element_at(later, F.lit(1)))
        reverted = F.when(one_day, x["x"]["one_day_end"]).otherwise(mate["x"]["date"])
        used = F.when(mate.isNotNull(), F.concat(acc["used"], F.array(mate["i"]))).otherwise(acc["used"])
        found = F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), reverted.alias("reverted")))).alias("out"))
        return F.when(F.array_contains(acc["used"], x["i"]), acc).otherwise(found)

    picked = listed.select("symbol", "rows", F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("o"))
    x = F.col("rows")[F.col("o.i")]
    return picked.select("symbol", x["date"].alias("date"), x["prev_date"].alias("prev_date"), F.exp(x["shift"]).alias("measured_ratio"), x["z"].alias("z_score"), F.col("o.reverted").alias("reverted_on"))


def witness_move(rows: DataFrame, witness: DataFrame, prev_col: str, date_col: str, name: str = "witness_ln") -> DataFrame:
    """ln of the witness's first close at or after ``date_col`` over its last at or before ``prev_col``."""
    w = close_series(witness)
    b = asof(rows, w, "symbol", prev_col, "date", F.struct("close"), "_b")
    a = asof(b, w, "symbol", date_col, "date", F.struct("close"), "_a", forward=True)
    x, y = F.col("_b.close"), F.col("_a.close")
    return a.withColumn(name, F.when((x > 0) & (y > 0), F.log(y / x))).drop("_a", "_b")


def classify_jumps(jumps: DataFrame, witness: DataFrame | None, s: BreakSettings = BreakSettings()) -> DataFrame:
    """Adds witness_ratio and classification."""
    moved = jumps.withColumn("witness_ln", F.lit(None).cast("double")) if witness is None else witness_move(jumps, witness, "prev_date", "date")
    wm, shift = F.col("witness_ln"), F.log("measured_ratio")
    off = F.abs(wm - shift)
    kind = F.when(off <= s.claim_tol_ln, REAL_MOVE).when(off > F.greatest(F.lit(s.witness_disagree_ln), 0.5 * F.abs(shift)), PROVIDER_BREAK).otherwise(UNEXPLAINED)
    return moved.withColumns({"witness_ratio": F.exp(wm), "classification": kind}).drop("witness_ln")


def claims_vs_witness(claims: DataFrame, witness: DataFrame, s: BreakSettings = BreakSettings()) -> DataFrame:
    """Claims with ``verdict``: confirmed, contradicted, unclear or unavailable. Contradicted ones are to be dropped."""
    prior = asof(claims, close_series(witness), "symbol", "date", "date", F.struct("date"), "_p", strict=True).withColumn("_prev", F.col("_p.date"))
    seen = witness_move(prior, witness, "_prev", "date")
    implied, wm = implied_ln(), F.col("witness_ln")
    off = F.abs(wm - implied)
    large = F.abs(implied) >= s.min_jump_ln
    verdict = (
        F.when(implied.isNull(), "unclear").when(wm.isNull(), "unavailable").when(off <= s.claim_tol_ln, "confirmed")
        .when(large & (off > F.greatest(F.lit(s.witness_disagree_ln), 0.5 * F.abs(implied))), "contradicted").otherwise("unclear")
    )
    return seen.withColumns({"verdict": verdict, "witness_ratio": F.exp(wm)}).drop("_p", "_prev", "witness_ln")


def check_claims_against_witness(claims: DataFrame, witness: DataFrame, s: BreakSettings = BreakSettings()) -> DataFrame:
    return claims_vs_witness(claims, witness, s).filter("verdict != 'contradicted'").select(*claims.columns)
