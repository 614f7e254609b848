"""One query for each operator over the derived tape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.tape import bars_with_neighbours, local_tape, unique_boundaries, with_own_gap
from tapeline.operators import breaks, claims, factors, feed, guard, identity, reconcile
from tapeline.plans.fixtures import fixture
from tapeline.schemas import last_bar_dates, normalise_claims
from tapeline.settings import ChainSettings, GuardSettings
from tapeline.sources.readers import symbols_of

CHAIN = ChainSettings(source_priority=("tape_confirmed", "price_feed"))
_CLAIM = ("symbol", "date", "ratio_from", "ratio_to", "source", "type", "rid")


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _bars(spark: SparkSession, d: str, name: str = "fx_bars") -> DataFrame:
    return fixture(spark, d, name).select("symbol", "date", "open", "high", "low", "close", "volume")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return normalise_claims(fixture(spark, d, "fx_claims").withColumn("rid", F.col("rid").cast("bigint")))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return bars_with_neighbours(local_tape(_claims(spark, d), _bars(spark, d)))


def apply_adjustment_daily(spark: SparkSession, d: str) -> DataFrame:
    out = factors.apply_adjustment(_bars(spark, d), _claims(spark, d))
    return _rounded(out.select("symbol", "date", "price_factor", "adj_close", "adj_volume"), price_factor=9, adj_close=6, adj_volume=4)


def apply_adjustment_ticks_tz(spark: SparkSession, d: str) -> DataFrame:
    ticks = fixture(spark, d, "fx_ticks").withColumnRenamed("price", "close")
    out = factors.apply_adjustment(ticks, fixture(spark, d, "fx_tick_claims"), timestamp_col="ts", exchange_tz="Asia/Tokyo")
    return out.select("symbol", "event_id", F.round("adj_close", 6).alias("adj_close"), (F.col("price_factor") < 1).cast("int").alias("before_split"))


def factor_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(factors.build_factor_table(_claims(spark, d), "1990-01-01"), price_factor=9, volume_factor=9)


def gap_measure(spark: SparkSession, d: str) -> DataFrame:
    return with_own_gap(_claims(spark, d), _near(spark, d)).select("rid", F.round("gap", 9).alias("gap"))


def _stage(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fn(spark, d).kept.select(*_CLAIM)


def drop_mislabels(spark: SparkSession, d: str) -> claims.Stage:
    wrong = _claims(spark, d).filter(F.col("rid") % 10 == 5).select("symbol", "date", "ratio_from", "ratio_to", F.lit("spin-off notice").alias("citation"))
    return claims.drop_recorded_mislabels(_claims(spark, d), wrong)


def unique_boundary(spark: SparkSession, d: str) -> DataFrame:
    return unique_boundaries(_claims(spark, d), _bars(spark, d))


def _guarded(df: DataFrame) -> DataFrame:
    return _rounded(df.drop("volume"), open=6, high=6, low=6, close=6)


def bad_print_guard(spark: SparkSession, d: str) -> DataFrame:
    return _guarded(guard.guard_bars(_bars(spark, d, "fx_tick_bars"), fixture(spark, d, "fx_truth"), GuardSettings(dense_min_bars=2)))


def bad_print_guard_no_truth(spark: SparkSession, d: str) -> DataFrame:
    return _guarded(guard.guard_bars(_bars(spark, d)))


def truth_from_ticks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(guard.truth_from_ticks(fixture(spark, d, "fx_ticks")), truth_high=6, truth_low=6)


def jump_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = breaks.jump_candidates(_bars(spark, d))
    return out.select("symbol", "date", "prev_date", F.round("shift", 6).alias("shift"), F.when(F.col("z") != float("inf"), F.round("z", 4)).alias("z"), "one_day_end")


def scan_jumps(spark: SparkSession, d: str) -> DataFrame:
    return _told(breaks.scan_jumps(_bars(spark, d), _claims(spark, d)))


def _told(jumps: DataFrame) -> DataFrame:
    return jumps.select("symbol", "date", "prev_date", F.round("measured_ratio", 6).alias("measured_ratio"), F.when(F.col("z_score") != float("inf"), F.round("z_score", 4)).alias("z_score"), "reverted_on")


def _jumps(spark: SparkSession, d: str) -> DataFrame:
    return breaks.jump_candidates(_bars(spark, d)).select("symbol", "date", "prev_date", F.exp("shift").alias("measured_ratio"))


def classify_jumps(spark: SparkSession, d: str) -> DataFrame:
    out = breaks.classify_jumps(_jumps(spark, d), fixture(spark, d, "fx_witness"))
    return out.select("symbol", "date", F.round("witness_ratio", 6).alias("witness_ratio"), "classification")


def witness_move(spark: SparkSession, d: str) -> DataFrame:
    out = breaks.witness_move(_jumps(spark, d), fixture(spark, d, "fx_witness"), "prev_date", "date")
    return out.select("symbol", "date", F.round("witness_ln", 9).alias("witness_ln"))


def claims_vs_witness(spark: SparkSession, d: str) -> DataFrame:
    out = breaks.claims_vs_witness(_claims(spark, d), fixture(spark, d, "fx_witness"))
    return out.select("rid", "verdict", F.round("witness_ratio", 6).alias("witness_ratio"))


def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feed.stale_runs(fixture(spark, d, "fx_frozen"), fixture(spark, d, "fx_calm")), close=6, witness_move=9)


def date_shifts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feed.date_shifts(fixture(spark, d, "fx_shifted"), fixture(spark, d, "fx_calm")), aligned_error=6, shifted_error=6)


def reconcile_all(spark: SparkSession, d: str) -> DataFrame:
    told = spark.createDataFrame([("S9", "reference does not track spin-offs")], "symbol string, explanation string")
    return reconcile.reconcile(fixture(spark, d, "fx_ours"), fixture(spark, d, "fx_reference"), told)


def reconcile_levels(spark: SparkSession, d: str) -> DataFrame:
    out = reconcile_all(spark, d).filter(F.col("classification") != reconcile.NOT_COMPARABLE).drop("classification", "detail", "event_issues")
    return _rounded(out, median_abs_ln_diff=9, max_abs_ln_diff=9, mean_ln_diff=9, std_ln_diff=6)


def reconcile_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reconcile_all(spark, d), median_abs_ln_diff=9, max_abs_ln_diff=9, mean_ln_diff=9, std_ln_diff=6)


def reconcile_gate(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.gate(reconcile_all(spark, d))


def rekey(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(identity.rekey_by_security(_bars(spark, d).select("symbol", "date", "close"), fixture(spark, d, "fx_history")), close=6)


def security_bars(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(identity.security_bars(_bars(spark, d), fixture(spark, d, "fx_history")).select("symbol", "date", "close"), close=6)


def history_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return identity.history_problems(fixture(spark, d, "fx_overlaps"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tapeline.plans.gauntlet import scorecard_query, vintage_query

    return {
        "apply_adjustment_daily": apply_adjustment_daily,
        "apply_adjustment_ticks_tz": apply_adjustment_ticks_tz,
        "factor_table": factor_table,
        "gap_measure": gap_measure,
        "drop_mislabels": _stage(drop_mislabels),
        "drop_post_coverage": _stage(lambda s, d: claims.drop_post_coverage(_claims(s, d), _bars(s, d))),
        "compose_legs": _stage(lambda s, d: claims.compose_same_day_legs(_claims(s, d), _near(s, d), CHAIN)),
        "collapse_duplicates": _stage(lambda s, d: claims.collapse_duplicates(_claims(s, d), _near(s, d), CHAIN)),
        "collapse_same_date": _stage(lambda s, d: claims.collapse_same_date(_claims(s, d), _near(s, d), CHAIN)),
        "collapse_near_date": _stage(lambda s, d: claims.collapse_near_date(_claims(s, d), _near(s, d), CHAIN)),
        "unique_boundary": unique_boundary,
        "snap_to_tape": _stage(lambda s, d: claims.snap_to_tape(_claims(s, d), _bars(s, d), CHAIN)),
        "refute_phantoms": _stage(lambda s, d: claims.refute_phantoms(_claims(s, d), _near(s, d), None, CHAIN)),
        "collapse_all": _stage(lambda s, d: claims.collapse_all(_claims(s, d), _bars(s, d), s=CHAIN)),
        "collapse_audit": lambda s, d: claims.collapse_all(_claims(s, d), _bars(s, d), s=CHAIN).audit,
        "collapse_totals": lambda s, d: claims.stage_totals(claims.collapse_all(_claims(s, d), _bars(s, d), s=CHAIN).audit),
        "collapse_without_tape": _stage(lambda s, d: claims.collapse_all(_claims(s, d), s=CHAIN)),
        "bad_print_guard": bad_print_guard,
        "bad_print_guard_no_truth": bad_print_guard_no_truth,
        "truth_from_ticks": truth_from_ticks,
        "jump_candidates": jump_candidates,
        "scan_jumps": scan_jumps,
        "classify_jumps": classify_jumps,
        "witness_move": witness_move,
        "claims_vs_witness": claims_vs_witness,
        "stale_runs": stale_runs,
        "date_shifts": date_shifts,
        "reconcile": reconcile_report,
        "reconcile_levels": reconcile_levels,
        "reconcile_gate": reconcile_gate,
        "rekey": rekey,
        "security_bars": security_bars,
        "history_overlaps": history_overlaps,
        "last_bar": lambda s, d: last_bar_dates(_bars(s, d)),
        "symbols": lambda s, d: symbols_of(_bars(s, d)),
        "gauntlet_scorecard": scorecard_query,
        "gauntlet_vintage": vintage_query,
    }
