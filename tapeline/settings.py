"""Tolerances of the operators, as frozen settings. The values are fixed by the semantics and stated plainly."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

TAPE_CONFIRMED = "tape_confirmed"


@dataclass(frozen=True)
class ChainSettings:
    # fixed values
    collapse_window_days: int = 150
    near_date_window_days: int = 10
    source_priority: tuple[str, ...] = (TAPE_CONFIRMED,)
    gap_pick_tolerance_ln: float = log(1.5)
    large_ratio_threshold_ln: float = log(2.0)
    snap_back_days: int = 15
    snap_fwd_days: int = 7
    snap_tolerance_ln: float = log(1.35)
    phantom_flat_tolerance_ln: float = log(1.2)
    phantom_disagreement_tolerance_ln: float = log(2.0)
    max_gap_calendar_days: int = 10
    compose_same_source_legs: bool = True


@dataclass(frozen=True)
class GuardSettings:
    # fixed values
    band_low: float = 0.55
    band_high: float = 1.8
    truth_sanity_band: float = 2.5
    range_insanity_ratio: float = 2.0
    range_contradiction_mult: float = 1.5
    dense_min_bars: int = 300
    dense_exceed_tol: float = 0.02
    confirm_tol: float = 0.02
    geometry_tol: float = 1e-4


@dataclass(frozen=True)
class BreakSettings:
    # fixed values
    z_threshold: float = 8.0
    min_jump_ln: float = log(1.5)
    vol_lookback: int = 60
    persist_bars: int = 3
    persist_tol_ln: float = log(1.35)
    claim_tol_ln: float = log(1.35)
    claim_window_days: int = 15
    revert_window_days: int = 120
    witness_disagree_ln: float = log(1.6)
    report_one_day_windows: bool = True


@dataclass(frozen=True)
class FeedSettings:
    # fixed values
    min_stale_run: int = 3
    own_run_quantile: float = 0.99
    least_runs_for_quantile: int = 20
    witness_move_ln: float = log(1.02)
    shift_window: int = 20
    shift_improvement: float = 0.5
    shift_min_error_ln: float = 0.004


@dataclass(frozen=True)
class ReconcileSettings:
    # fixed values
    exact_tol_ln: float = log(1.001)
    minor_tol_ln: float = log(1.02)
    parallel_tol_ln: float = log(1.001)
    min_date_overlap: int = 5
    event_step_tol_ln: float = log(1.01)
    event_date_window_days: int = 10


@dataclass(frozen=True)
class GauntletSettings:
    # fixed values
    n_instances_per_class: int = 20
    n_clean_symbols: int = 50
    n_trading_days: int = 504
    start_date: str = "2021-01-04"
    seed: int = 1337
    base_price_range: tuple[float, float] = (5.0, 400.0)
    daily_vol: float = 0.02
