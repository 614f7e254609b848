"""Two adjustment histories, compared event by event and class by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.tape import by_date
from tapeline.settings import ReconcileSettings

#: The outcome classes.
EXACT, MINOR, EQUIV, EXPLAINED, DATE_DIFFERS, MISMATCH, NOT_COMPARABLE = "EXACT", "MINOR", "EXACT_ADJUSTED_EQUIV", "EXPLAINED", "DATE_DIFFERS", "MISMATCH", "NOT_COMPARABLE"
PASSING = (EXACT, MINOR, EQUIV, EXPLAINED)


def aligned(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """(symbol, date, a, b): both factors on every date of either side, each carried forward, both positive."""
    side = lambda df, c: df.select("symbol", F.col("date").cast("date").alias("date"), F.col("factor").cast("double").alias(c))
    both = side(ours, "a").join(side(reference, "b"), ["symbol", "date"], "full_outer")
    upto = by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("a", "b")})
    return carried.filter("a > 0 and b > 0")


def _match(s: ReconcileSettings) -> Column:
    """Fold over our events by date: each takes the nearest unused reference event of its size, else one of its day."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<kind:string,text:string>>").alias("issues"))
    refs = F.transform("er", lambda x, i: F.struct(i.alias("i"), x["date"].alias("date"), x["step"].alias("step")))
    say = lambda kind, fmt, *args: F.struct(F.lit(kind).alias("kind"), F.format_string(f"{kind} {fmt}", *args).alias("text"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(refs, lambda y: ~F.array_contains(acc["used"], y["i"]))
        days = lambda y: F.abs(F.datediff(y["date"], x["date"]))
        near = F.filter(free, lambda y: (F.abs(y["step"] - x["step"]) <= s.minor_tol_ln) & (days(y) <= s.event_date_window_days))
        best = F.array_min(F.transform(near, lambda y: F.struct(days(y).alias("days"), y["i"].alias("i"), y["date"].alias("date"))))
        same = F.try_element_at(F.filter(free, lambda y: y["date"] == x["date"]), F.lit(1))
        took = F.coalesce(best["i"], same["i"])
        ratio = F.exp(x["step"])
        issue = (
            F.when(best.isNotNull() & (best["days"] > 0), say(DATE_DIFFERS, "ours %s ref %s x%.4f", x["date"].cast("string"), best["date"].cast("string"), ratio))
            .when(best.isNotNull(), F.lit(None))
            .when(same.isNotNull(), say("RATIO_DIFFERS", "%s ours x%.4f ref x%.4f", x["date"].cast("string"), ratio, F.exp(same["step"])))
            .otherwise(say("ONLY_OURS", "%s x%.4f", x["date"].cast("string"), ratio))
        )
        used = F.when(took.isNotNull(), F.concat(acc["used"], F.array(took))).otherwise(acc["used"])
        issues = F.when(issue.isNotNull(), F.concat(acc["issues"], F.array(issue))).otherwise(acc["issues"])
        return F.struct(used.alias("used"), issues.alias("issues"))

    def end(acc: Column) -> Column:
        left = F.filter(refs, lambda y: ~F.array_contains(acc["used"], y["i"]))
        rest = F.transform(left, lambda y: say("ONLY_REFERENCE", "%s x%.4f", y["date"].cast("string"), F.exp(y["step"])))
        return F.concat(acc["issues"], rest)

    return F.aggregate("eo", start, step, end)


def reconcile(ours: DataFrame, reference: DataFrame, explanations: DataFrame | None = None, symbols: DataFrame | None = None, s: ReconcileSettings = ReconcileSettings()) -> DataFrame:
    """A row per symbol: classification, detail, statistics of the level differences, and the event issues."""
    j = aligned(ours, reference).withColumns({"diff": F.log("a") - F.log("b"), "sa": F.log("a") - F.lag(F.log("a")).over(by_date()), "sb": F.log("b") - F.lag(F.log("b")).over(by_date())})
    events = lambda c: F.sort_array(F.collect_list(F.when(F.abs(c) > s.event_step_tol_ln, F.struct("date", F.col(c).alias("step")))))
    stats = j.groupBy("symbol").agg(
        F.count("*").alias("n"), F.percentile(F.abs("diff"), F.lit(0.5)).alias("median_abs"), F.max(F.abs("diff")).alias("max_abs"),
        F.avg("diff").alias("mean_ln"), F.stddev_pop("diff").alias("std_ln"), events("sa").alias("eo"), events("sb").alias("er"),
    )
    sides = [df.select("symbol").distinct().withColumn(f"_{k}", F.lit(True)) for k, df in (("o", ours), ("r", reference))]
    names = sides[0].join(sides[1], "symbol", "full_outer")
    if symbols is not None:
        names = symbols.select("symbol").distinct().join(names, "symbol", "left")
    r = names.join(stats, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if explanations is None:
        r = r.withColumn("_why", F.lit(None).cast("string"))
    else:
        r = r.join(explanations.select("symbol", F.col("explanation").alias("_why")).dropDuplicates(["symbol"]), "symbol", "left")
    r = r.withColumn("issues", F.coalesce(_match(s), F.array().cast("array<struct<kind:string,text:string>>")))
    one_side = F.col("_o").isNull() | F.col("_r").isNull()
    few = F.col("n") < s.min_date_overlap
    none, texts = F.size("issues") == 0, F.concat_ws("; ", F.transform("issues", lambda x: x["text"]))
    only_dates = ~none & F.forall("issues", lambda x: x["kind"] == DATE_DIFFERS)
    told = F.coalesce(F.col("_why") != "", F.lit(False))
    kind = (
        F.when(one_side | few, NOT_COMPARABLE).when(none & (F.col("max_abs") <= s.exact_tol_ln), EXACT).when(none & (F.col("max_abs") <= s.minor_tol_ln), MINOR)
        .when(none & (F.col("std_ln") <= s.parallel_tol_ln), EQUIV).when(told, EXPLAINED).when(only_dates, DATE_DIFFERS).otherwise(MISMATCH)
    )
    r = r.withColumn("classification", kind)
    c = F.col("classification")
    detail = (
        F.when(one_side, "one or both sides have no data")
        .when(few, F.format_string("%d common date(s), at least %d needed", F.col("n"), F.lit(s.min_date_overlap)))
        .when(c == EXACT, "all events and all dates agree exactly").when(c == MINOR, "all events agree, levels within the minor tolerance")
        .when(c == EQUIV, "all events agree, levels differ by a constant").when(c == EXPLAINED, F.col("_why")).when(~none, texts)
        .otherwise(F.format_string("no event differs, but levels do by up to %.4f and not in parallel", F.col("max_abs")))
    )
    shown = lambda x: F.when(c != NOT_COMPARABLE, x)
    return r.select(
        "symbol", "classification", detail.alias("detail"), F.col("n").cast("bigint").alias("n_dates_compared"), shown(F.col("median_abs")).alias("median_abs_ln_diff"),
        shown(F.col("max_abs")).alias("max_abs_ln_diff"), shown(F.col("mean_ln")).alias("mean_ln_diff"), shown(F.col("std_ln")).alias("std_ln_diff"),
        F.coalesce(shown(F.size("eo")), F.lit(0)).cast("bigint").alias("n_events_ours"), F.coalesce(shown(F.size("er")), F.lit(0)).cast("bigint").alias("n_events_reference"),
        F.when(c == NOT_COMPARABLE, "").otherwise(texts).alias("event_issues"),
    )


def gate(results: DataFrame, min_pass_rate: float = 0.99) -> DataFrame:
    """One row: counts, pass rate of the comparable symbols (1 if there are none) and whether it is high enough."""
    c = F.col("classification")
    counts = results.agg(F.count("*").alias("n_total"), F.count_if(c != NOT_COMPARABLE).alias("n_comparable"), F.count_if(c == NOT_COMPARABLE).alias("n_not_comparable"), F.count_if(c.isin(*PASSING)).alias("n_passing"), F.count_if(c == MISMATCH).alias("n_mismatch"))
    rate = F.when(F.col("n_comparable") > 0, F.col("n_passing") / F.when(F.col("n_comparable") > 0, F.col("n_comparable"))).otherwise(1.0)
    return counts.withColumn("pass_rate", rate).withColumns({"min_pass_rate": F.lit(min_pass_rate), "gate_passed": F.col("pass_rate") >= min_pass_rate})
