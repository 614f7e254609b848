"""Planted-truth harness: symbols with a known fault or a known legitimate event, run through the engine and scored.

Everything is drawn from hashes of (seed, class, instance), so a universe is the same on any cluster and at any
parallelism. Each class is a row of a small table; the tape, the claims and the expectations follow from it by joins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.scratch import materialize
from tapeline.functions.tape import bars_with_neighbours, by_date
from tapeline.operators import breaks, claims, guard
from tapeline.settings import ChainSettings, GauntletSettings

#: Class -> category. A known gap is expected to get through.
CLASSES = {
    "duplicate_actions": "defect", "same_date_contradiction": "defect", "near_date_fake": "defect", "post_coverage_action": "defect",
    "spinoff_mislabel": "defect", "misdated_action": "defect", "phantom_action": "defect", "in_band_phantom_dip": "defect",
    "extreme_ratio_real_split": "legitimate", "mixed_vintage_ohl": "legitimate", "envelope_wick": "legitimate", "serial_reverse_split": "legitimate",
    "halted_reverse_split": "legitimate", "real_small_ratio_split": "legitimate", "bad_close_vspike": "known_gap", "small_ratio_phantom": "known_gap",
}
BREAK_CLASSES = ("break_from_day_x", "break_window_x_to_y", "break_one_day", "bogus_claim_on_break", "unclaimed_real_split", "clean_no_false_break")
#: Ratios (from, to) that a class draws one of. Classes without one have no split.
RATIOS = {
    "duplicate_actions": ((1, 2), (1, 4), (1, 5), (1, 10)), "same_date_contradiction": ((1, 2), (1, 3), (1, 4), (1, 5)), "near_date_fake": ((5, 1), (10, 1), (20, 1)),
    "post_coverage_action": ((1, 10),), "spinoff_mislabel": ((1, 2),), "misdated_action": ((1, 4), (1, 5), (1, 8), (1, 10)), "phantom_action": ((1, 3), (1, 4), (1, 5)),
    "extreme_ratio_real_split": ((50, 1), (75, 1), (100, 1)), "mixed_vintage_ohl": ((1, 3), (1, 4), (1, 5)), "serial_reverse_split": ((5, 1), (8, 1), (10, 1)),
    "halted_reverse_split": ((10, 1), (15, 1), (20, 1)), "real_small_ratio_split": ((2, 3), (4, 5)), "small_ratio_phantom": ((2, 3),),
}
_ON_TAPE = ("duplicate_actions", "same_date_contradiction", "near_date_fake", "spinoff_mislabel", "misdated_action", "extreme_ratio_real_split", "serial_reverse_split", "halted_reverse_split", "real_small_ratio_split")


class Universe(NamedTuple):
    plants: DataFrame
    bars: DataFrame
    claims: DataFrame
    truth: DataFrame
    vintage: DataFrame
    mislabels: DataFrame
    expected: DataFrame


def _u(seed: int, *parts: Column | str | int) -> Column:
    """Uniform in [0, 1) by a hash."""
    cols = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def calendar(spark: SparkSession, start: str, sessions: int) -> DataFrame:
    """(i, date): the weekdays from ``start`` on."""
    days = spark.range(sessions * 2).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date")).filter(F.weekday("date") < 5)
    return days.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).filter(F.col("i") < sessions)  # a calendar, some hundred rows


def _walk(symbols: DataFrame, days: DataFrame, s: GauntletSettings) -> DataFrame:
    """(symbol and its columns, i, date, level): a random walk from twelve uniforms a step, about normal."""
    z = sum((_u(s.seed, "symbol", "i", k) for k in range(12)), F.lit(0.0)) - 6.0
    lo, hi = s.base_price_range
    each = symbols.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(s.n_trading_days - 1))))
    steps = each.join(F.broadcast(days), "i").withColumn("step", F.lit(s.daily_vol) * z)  # the calendar has n_trading_days rows
    base = lo * F.pow(F.lit(hi / lo), _u(s.seed, "symbol", 99))
    return steps.withColumn("level", base * F.exp(F.sum("step").over(by_date()))).drop("step")


def build_universe(spark: SparkSession, s: GauntletSettings = GauntletSettings()) -> Universe:
    rows = []
    for name, category in [*CLASSES.items(), ("clean", "clean")]:
        for k in range(s.n_instances_per_class if name != "clean" else s.n_clean_symbols):
            rows.append((f"{name.upper()[:14]}_{k:03d}", name, category, k))
    plants = spark.createDataFrame(rows, "symbol string, class string, category string, k int")
    ratio = F.lit(None).cast("struct<f:double,t:double>")
    for name, options in RATIOS.items():
        picks = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(float(t)).alias("t")) for f, t in options])
        ratio = F.when(F.col("class") == name, picks[F.floor(_u(s.seed, "symbol", 1) * len(options)).cast("int")]).otherwise(ratio)
    n = s.n_trading_days
    plants = plants.withColumns({
        "r": ratio, "e": (F.lit(n // 3) + F.floor(_u(s.seed, "symbol", 2) * (n // 4))).cast("int"),
        "e2": F.floor(F.lit(42) + _u(s.seed, "symbol", 3) * 48).cast("int"), "off": (1 + F.floor(_u(s.seed, "symbol", 4) * 3)).cast("int"), "x": _u(s.seed, "symbol", 5),
    })
    plants = materialize(plants.withColumns({"m": F.when(F.col("class").isin(*_ON_TAPE), F.col("r.f") / F.col("r.t")).otherwise(1.0), "e2": F.col("e") + F.col("e2")}))
    days = materialize(calendar(spark, s.start_date, n))
    bars = _walk(plants, days, s)
    after = F.col("i") >= F.col("e")
    again = (F.col("class") == "serial_reverse_split") & (F.col("i") >= F.col("e2"))
    # after a halt the price resumes well away from where it stood
    resumed = F.when((F.col("class") == "halted_reverse_split") & after, 0.2 + 0.1 * F.col("x")).otherwise(1.0)
    # fixed values: how far a bad close stands off
    spike = F.when((F.col("class") == "bad_close_vspike") & (F.col("i") == F.col("e")), F.element_at(F.array(*map(F.lit, (6.0, 8.0, 0.15, 0.12))), (F.floor(F.col("x") * 4) + 1).cast("int"))).otherwise(1.0)
    close = F.col("level") * F.when(after, F.col("m")).otherwise(1.0) * F.when(again, F.col("m")).otherwise(1.0) * resumed * spike
    hole = (F.col("class") == "halted_reverse_split") & F.col("i").between(F.col("e") - 40, F.col("e") - 1)
    bars = bars.filter(~hole).withColumn("close", close)
    bars = bars.withColumn("open", F.col("close") * (1 + 0.004 * (_u(s.seed, "symbol", "i", 21) - 0.5)))
    top, low = F.greatest("open", "close"), F.least("open", "close")
    day = F.col("i") == F.col("e")
    wick = F.when(day & (F.col("class") == "envelope_wick"), 1.9 + 0.4 * F.col("x")).otherwise(1.005)
    dip = F.when(day & (F.col("class") == "in_band_phantom_dip"), 0.75).otherwise(0.995)
    bars = materialize(bars.select("symbol", "date", "i", "class", "e", "open", (top * wick).alias("high"), (low * dip).alias("low"), "close", F.lit(1000).cast("bigint").alias("volume")))
    truth = bars.filter((F.col("i") == F.col("e")) & F.col("class").isin("envelope_wick", "in_band_phantom_dip")).select(
        "symbol", "date", F.when(F.col("class") == "envelope_wick", F.col("high")).otherwise(F.greatest("open", "close") * 1.005).alias("truth_high"),
        F.when(F.col("class") == "in_band_phantom_dip", F.least("open", "close") * 0.985).otherwise(F.col("low")).alias("truth_low"), F.lit(390).cast("bigint").alias("truth_n"),
    )
    at = plants.filter(F.col("r").isNotNull()).join(days.select(F.col("i").alias("e"), F.col("date").alias("d")), "e").join(days.select(F.col("i").alias("e2"), F.col("date").alias("d2")), "e2", "left")
    last = days.agg(F.max("date")).first()[0]
    f, t = F.col("r.f"), F.col("r.t")

    def claim(day: Column, frm: Column, to: Column, source: str) -> Column:
        return F.struct(day.cast("date").alias("date"), frm.alias("ratio_from"), to.alias("ratio_to"), F.lit(source).alias("source"))

    d, one = F.col("d"), lambda *c: F.array(*c)
    days_off = lambda lo, span: (F.lit(lo) + F.floor(F.col("x") * span)).cast("int")
    late = F.date_add(F.lit(last), days_off(200, 500))
    told = (
        F.when(F.col("class") == "duplicate_actions", one(claim(d, f, t, "price_feed"), claim(F.date_add(d, days_off(3, 57)), f, t, "filing"), claim(F.date_sub(d, days_off(3, 57)), f, t, "text")))
        .when(F.col("class") == "same_date_contradiction", one(claim(d, f, t, "filing"), claim(d, t, f, "text")))
        .when(F.col("class") == "near_date_fake", one(claim(d, f, t, "text"), claim(F.date_add(d, days_off(2, 7)), f * 3, t, "filing")))
        .when(F.col("class") == "post_coverage_action", one(claim(late, f, t, "filing")))
        .when(F.col("class") == "misdated_action", one(claim(F.when(F.col("x") < 0.5, F.date_add(d, F.col("off"))).otherwise(F.date_sub(d, F.col("off"))), f, t, "filing")))
        .when(F.col("class") == "serial_reverse_split", one(claim(d, f, t, "filing"), claim(F.col("d2"), f, t, "filing")))
        .otherwise(one(claim(d, f, t, "filing")))
    )
    raw = at.select("symbol", F.posexplode(told).alias("j", "c")).select("symbol", "c.*", F.lit("split").alias("type"), F.xxhash64("symbol", "j").alias("rid"))
    keep = (
        F.when(F.col("class").isin("post_coverage_action", "spinoff_mislabel", "phantom_action"), F.array().cast("array<struct<date:date,ratio_from:double,ratio_to:double>>"))
        .when(F.col("class") == "serial_reverse_split", F.array(*[F.struct(x.alias("date"), f.alias("ratio_from"), t.alias("ratio_to")) for x in (d, F.col("d2"))]))
        .otherwise(F.array(F.struct(d.alias("date"), f.alias("ratio_from"), t.alias("ratio_to"))))
    )
    expected = at.select("symbol", F.explode(keep).alias("w")).select("symbol", "w.*")
    vintage = at.filter(F.col("class") == "mixed_vintage_ohl").select("symbol", F.col("d").alias("date"), F.lit("ADJUSTED").alias("vintage"))
    mislabels = at.filter(F.col("class") == "spinoff_mislabel").select("symbol", F.col("d").alias("date"), f.alias("ratio_from"), t.alias("ratio_to"), F.lit("spin-off").alias("citation"))
    return Universe(plants, bars.select("symbol", "date", "open", "high", "low", "close", "volume"), materialize(raw), materialize(truth), materialize(vintage), materialize(mislabels), materialize(expected))


def score(u: Universe) -> DataFrame:
    """A row per class: category, n, rate of instances with exactly the expected outcome, and false-positive bars."""
    kept = claims.collapse_all(u.claims, u.bars, u.mislabels, u.vintage, ChainSettings(source_priority=("tape_confirmed", "price_feed"))).kept
    key = ["symbol", "date", "ratio_from", "ratio_to"]
    both = kept.select(*key).withColumn("got", F.lit(True)).join(u.expected.withColumn("want", F.lit(True)), key, "full_outer")
    wrong = both.groupBy("symbol").agg(F.max((F.col("got").isNull() | F.col("want").isNull()).cast("int")).alias("wrong"))
    guarded = guard.guard_bars(u.bars, u.truth)
    flags = guarded.groupBy("symbol").agg(F.count_if(F.col("bad_print_flag") == 1).alias("bad"), F.count_if((F.col("bad_print_flag") == 1) & (F.col("repair_source") == "truth")).alias("by_truth"), F.count_if(F.col("confirmed_extreme") == 1).alias("confirmed"), F.count("*").alias("bars"))
    p = u.plants.join(wrong, "symbol", "left").join(flags, "symbol", "left")
    fine = F.coalesce(F.col("wrong"), F.lit(0)) == 0
    good = (
        F.when(F.col("class") == "in_band_phantom_dip", F.col("by_truth") == 1).when(F.col("class") == "envelope_wick", (F.col("confirmed") == 1) & (F.col("bad") == 0))
        .when(F.col("class") == "bad_close_vspike", F.col("bad") > 0).when(F.col("class") == "small_ratio_phantom", ~fine).otherwise(fine)
    )
    return p.groupBy("class", "category").agg(F.count("*").alias("n"), F.avg(good.cast("double")).alias("rate"), (F.sum("bad") / F.sum("bars")).alias("flagged_bars"))


def vintage_awareness(u: Universe) -> DataFrame:
    """How many real claims over tapes that came adjusted survive without and with the vintage table."""
    near = bars_with_neighbours(u.bars)
    real = u.claims.join(u.vintage.select("symbol").distinct(), "symbol", "left_semi")
    kept = [claims.refute_phantoms(real, near, v).kept.select(F.lit(name).alias("vintage")) for name, v in (("without", None), ("with", u.vintage))]
    n = real.agg(F.count("*").alias("n"))
    counts = kept[0].unionByName(kept[1]).groupBy("vintage").agg(F.count("*").alias("survived"))
    names = u.claims.sparkSession.createDataFrame([("without",), ("with",)], "vintage string")
    return names.join(F.broadcast(counts), "vintage", "left").join(F.broadcast(n)).select("vintage", F.coalesce("survived", F.lit(0)).alias("survived"), "n")


def break_benchmark(spark: SparkSession, rounds: int = 20, sessions: int = 252, seed: int = 2026) -> DataFrame:
    """A row per break class with the rate of rounds handled right."""
    s = GauntletSettings(seed=seed, n_trading_days=sessions)
    plants = spark.createDataFrame([(f"{c.upper()}_{k:02d}", c, k) for c in BREAK_CLASSES for k in range(rounds)], "symbol string, class string, k int")
    size = F.element_at(F.array(*map(F.lit, (10.0, 0.1, 4.0, 0.2))), (F.floor(_u(seed, "symbol", 1) * 4) + 1).cast("int"))
    plants = materialize(plants.withColumns({"e": (100 + F.floor(_u(seed, "symbol", 2) * 60)).cast("int"), "x": size}))
    days = materialize(calendar(spark, s.start_date, sessions))
    tape = materialize(_walk(plants, days, s))
    kind, i, e = F.col("class"), F.col("i"), F.col("e")
    off = (
        F.when(kind.isin("break_from_day_x", "bogus_claim_on_break", "unclaimed_real_split") & (i >= e), F.col("x"))
        .when((kind == "break_window_x_to_y") & (i >= e) & (i < e + 30), F.col("x")).when((kind == "break_one_day") & (i == e), F.col("x")).otherwise(1.0)
    )
    bars = materialize(tape.select("symbol", "date", (F.col("level") * off).alias("close")))
    witness = materialize(tape.select("symbol", "date", (F.col("level") * F.when((kind == "unclaimed_real_split") & (i >= e), F.col("x")).otherwise(1.0)).alias("close")))
    day = plants.join(days.select(F.col("i").alias("e"), F.col("date").alias("day")), "e").select("symbol", "class", "day", "x")
    bogus = day.filter(F.col("class") == "bogus_claim_on_break").select("symbol", F.col("day").alias("date"), F.when(F.col("x") > 1, F.col("x")).otherwise(1.0).alias("ratio_from"), F.when(F.col("x") < 1, 1 / F.col("x")).otherwise(1.0).alias("ratio_to"), F.xxhash64("symbol").alias("rid"))
    left = materialize(breaks.check_claims_against_witness(bogus, witness))
    found = breaks.classify_jumps(breaks.scan_jumps(bars, left), witness)
    per = found.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("date"), F.max("classification").alias("kind"), F.max("reverted_on").alias("reverted"))
    p = day.join(per, "symbol", "left").join(left.select("symbol", F.lit(True).alias("stayed")), "symbol", "left")
    one = (F.col("n") == 1) & (F.col("date") == F.col("day"))
    broken = one & (F.col("kind") == breaks.PROVIDER_BREAK)
    good = (
        F.when(F.col("class") == "clean_no_false_break", F.col("n").isNull()).when(F.col("class") == "unclaimed_real_split", one & (F.col("kind") == breaks.REAL_MOVE))
        .when(F.col("class") == "bogus_claim_on_break", broken & F.col("stayed").isNull()).when(F.col("class") == "break_from_day_x", broken & F.col("reverted").isNull())
        .otherwise(broken & F.col("reverted").isNotNull())
    )
    return p.groupBy("class").agg(F.count("*").alias("n"), F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("rate"))


def scorecard(spark: SparkSession, s: GauntletSettings = GauntletSettings(), rounds: int = 20) -> DataFrame:
    """Classes of both benchmarks with what is asked of them and whether it is met."""
    main = score(build_universe(spark, s)).select("class", "category", "n", F.round("rate", 4).alias("rate"), F.round("flagged_bars", 6).alias("flagged_bars"))
    more = break_benchmark(spark, rounds).select("class", F.lit("break").alias("category"), "n", F.round("rate", 4).alias("rate"), F.lit(None).cast("double").alias("flagged_bars"))
    floor = F.when(F.col("category") == "defect", 0.8).when(F.col("category").isin("legitimate", "break"), 0.95)
    met = F.when(F.col("category") == "clean", (F.col("rate") == 1) & (F.col("flagged_bars") <= 0.02)).when(floor.isNull(), True).otherwise(F.col("rate") >= floor)
    return main.unionByName(more).withColumns({"floor": floor, "met": met})


def vintage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vintage_awareness(build_universe(spark, GauntletSettings(n_instances_per_class=6, n_clean_symbols=2)))


def scorecard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard at a small size; it reads no table."""
    return scorecard(spark, GauntletSettings(n_instances_per_class=6, n_clean_symbols=10), rounds=6)
