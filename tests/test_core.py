import datetime as dt
import math
import random

import pytest
from tape import bars, day, rows

from tapeline.functions.asof import asof
from tapeline.operators import breaks, factors, feed, guard, identity, reconcile
from tapeline.settings import GauntletSettings
from tapeline.sources import readers as R


def claims(spark, *rs):
    return R.claims_from_memory(spark, rs)


def walk(n, seed=1, vol=0.01, base=100.0):
    r, out = random.Random(seed), [base]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(r.gauss(0, vol)))
    return out


# -- as-of ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, forward, strict):
    from pyspark.sql import functions as F

    r = random.Random(3)
    left = [(r.choice("AB"), r.randrange(20), i) for i in range(40)]
    right = [("A", t, t * 10) for t in sorted(r.sample(range(20), 8))] + [("C", 1, 1)]
    got = asof(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, u int, v int"), "k", "t", "u", F.struct("v"), "hit", forward, strict)
    for k, t, _, v in rows(got.select("k", "t", "i", "hit.v"), "k", "t", "i", "v"):
        ok = [u for s, u, _ in right if s == k and ((u > t if forward else u < t) or (u == t and not strict))]
        assert v == ((min(ok) if forward else max(ok)) * 10 if ok else None)


# -- factors ----------------------------------------------------------------------------------------------------------
def test_adjustment(spark):
    b = bars(spark, ("A", [80.0, 84.0, 20.5, 20.0, 21.0, 107.0, 103.0]), ("B", [5.0]))
    out = factors.apply_adjustment(b, claims(spark, ("A", day(2), 1, 4), ("A", day(5), 5, 1)))
    assert [r[2] for r in rows(out.filter("symbol = 'A'"), "symbol", "date", "price_factor")] == [1.25] * 2 + [5.0] * 3 + [1.0] * 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Sort ") == plan.count("Sort [symbol")  # only the events are sorted
    assert rows(out.filter("symbol = 'B'"), "adj_close", "adj_volume") == [(5.0, 1000.0)]


def test_factor_table(spark):
    t = factors.build_factor_table(claims(spark, ("A", day(4), 1, 8), ("A", day(11), 6, 1)), str(day(1)))
    assert rows(t, "date", "price_factor") == [(day(1), 0.75), (day(4), 6.0), (day(11), 1.0)]


def test_time_zones(spark):
    c = claims(spark, ("A", dt.date(2023, 1, 9), 1, 10))
    ts = spark.sql("select 'A' as symbol, timestamp'2023-01-08 23:30:00' as ts, 100.0D as close")
    naive = spark.sql("select 'A' as symbol, timestamp_ntz'2023-01-08 23:30:00' as ts, 100.0D as close")
    for df in (ts, naive):
        assert rows(factors.apply_adjustment(df, c, "ts", "Asia/Tokyo"), "price_factor") == [(1.0,)]
        assert rows(factors.apply_adjustment(df, c, "ts", "America/New_York"), "price_factor") == [(0.1,)]
        assert rows(factors.apply_adjustment(df, c, "ts", "America/New_York", {"A": "Asia/Tokyo"}), "price_factor") == [(1.0,)]
        own = spark.createDataFrame([("A", "Asia/Tokyo"), ("B", "UTC")], "symbol string, zone string")
        assert rows(factors.apply_adjustment(df, c, "ts", "America/New_York", own), "price_factor") == [(1.0,)]


# -- guard ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("ohlc", "truth", "want"),
    [
        ((100, 250, 99, 100), None, (100, 100, 99, "envelope", 1, 0)),
        ((100, 220, 97, 100), (220, 97, 390), (100, 220, 97, "confirmed", 0, 1)),
        ((100, 103, 75, 100), (102, 98.5, 390), (100, 103, 98.5, "truth", 1, 0)),
        ((100, 103, 75, 100), (102, 98.5, 10), (100, 103, 75, None, 0, 0)),
        ((6.66, 6.72, 1.0, 1.13), (6.75, 1.0, 17), (6.66, 6.72, 1.0, "confirmed", 0, 1)),
        ((689.6, 696.9, 69.0, 695.4), (697.5, 681.9, 17), (689.6, 696.9, 681.9, "truth", 1, 0)),
    ],
)
def test_guard(spark, ohlc, truth, want):
    df = spark.createDataFrame([("A", day(0), *map(float, ohlc), 7)], "symbol string, date date, open double, high double, low double, close double, volume bigint")
    t = R.truth_from_memory(spark, {("A", day(0)): dict(zip(("high", "low", "n_bars"), map(float, truth), strict=True))}) if truth else None
    r = guard.guard_bars(df, t).first()
    assert (r.open, r.high, r.low, r.repair_source, r.bad_print_flag, r.confirmed_extreme) == want
    assert r.volume == 7


def test_guard_runs_on_a_stream(spark, tmp_path):
    from tapeline.streaming.live import guard_stream

    df = spark.createDataFrame([("A", day(0), 100.0, 250.0, 99.0, 100.0)], "symbol string, date date, open double, high double, low double, close double")
    df.write.parquet(str(tmp_path / "in"))
    live = guard_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("guarded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("guarded").first().high == 100.0


def test_rekey_and_truth_on_streams(spark, tmp_path):
    from tapeline.streaming.live import rekey_stream, truth_stream

    def run(df, fn, name, mode):
        path = str(tmp_path / name)
        df.write.parquet(path)
        q = fn(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    h = history(spark, ("ID1", "T", day(0), day(4)), ("ID2", "T", day(5), None))
    dated = spark.createDataFrame([("T", day(3)), ("T", day(6)), ("X", day(3))], "symbol string, date date")
    assert rows(run(dated, lambda s: rekey_stream(s, h), "rekeyed", "append"), "symbol", "ticker") == [("ID1", "T"), ("ID2", "T"), ("X", "X")]
    at = lambda d, hour: dt.datetime(2023, 1, d, hour)
    ticks = spark.createDataFrame([("A", at(2, 9), 7.0), ("A", at(2, 15), 9.0), ("A", at(9, 1), 1.0)], "symbol string, ts timestamp, price double")
    seen = run(ticks, truth_stream, "truths", "complete")
    assert rows(seen, "date", "truth_high", "truth_low", "truth_n") == [(dt.date(2023, 1, 2), 9.0, 7.0, 2), (dt.date(2023, 1, 9), 1.0, 1.0, 1)]


# -- breaks -----------------------------------------------------------------------------------------------------------
def test_breaks(spark):
    w = walk(250)
    lasting, window, one = (list(w) for _ in range(3))
    lasting[120:] = [x * 10 for x in w[120:]]
    window[120:150] = [x * 10 for x in w[120:150]]
    one[120] = w[120] * 10
    b = bars(spark, ("L", lasting), ("W", window), ("O", one), ("C", w))
    witness = bars(spark, *[(s, w) for s in "LWOC"])
    got = breaks.classify_jumps(breaks.scan_jumps(b), witness)
    assert rows(got, "symbol", "date", "reverted_on", "classification") == [("L", day(120), None, "PROVIDER_BREAK"), ("O", day(120), day(121), "PROVIDER_BREAK"), ("W", day(120), day(150), "PROVIDER_BREAK")]
    c = claims(spark, ("L", day(120), 10, 1))
    assert rows(breaks.scan_jumps(b, c), "symbol") == [("O",), ("W",)]
    assert breaks.check_claims_against_witness(c, witness).count() == 0
    assert {r[0] for r in rows(breaks.classify_jumps(breaks.scan_jumps(b), b), "classification")} == {"REAL_MOVE"}
    assert {r[0] for r in rows(breaks.classify_jumps(breaks.scan_jumps(b), None), "classification")} == {"UNEXPLAINED"}


def test_no_false_breaks(spark):
    assert breaks.scan_jumps(bars(spark, *[(f"S{k}", walk(252, k, 0.02)) for k in range(10)])).count() == 0


def test_reversals_pair_greedily(spark):
    """The fold over a symbol's jumps equals a plain loop."""
    w = walk(400, 5, 0.002)
    level, r, out = 1.0, random.Random(9), []
    for i, x in enumerate(w):
        if i in (80, 110, 140, 200, 230, 330):
            level = level * 10 if r.random() < 0.5 else level / 10
        out.append(x * level)
    b = bars(spark, ("A", out))
    cand = [tuple(x) for x in breaks.jump_candidates(b).orderBy("date").select("date", "shift", "one_day_end").collect()]
    used, want = set(), []
    for i, (d, shift, end) in enumerate(cand):
        if i in used:
            continue
        mate = next((j for j in range(i + 1, len(cand)) if end is None and j not in used and (cand[j][0] - d).days <= 120 and abs(shift + cand[j][1]) <= math.log(1.35)), None)
        used |= {mate} - {None}
        want.append((d, cand[mate][0] if mate is not None else end))
    assert len(cand) >= 5
    assert sorted(want, key=str) == sorted(rows(breaks.scan_jumps(b), "date", "reverted_on"), key=str)


# -- feed -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [3, 5, 10])
def test_frozen(spark, n):
    w = walk(200)
    frozen = list(w)
    frozen[100 : 100 + n] = [w[99]] * n
    got = feed.stale_runs(bars(spark, ("A", frozen)), bars(spark, ("A", walk(200, 2, 0.05))))
    assert rows(got, "start", "end", "n_bars", "classification") == [(day(99), day(99 + n), n + 1, "STALE_FEED")]
    assert rows(feed.stale_runs(bars(spark, ("A", frozen))), "classification") == [("UNVERIFIED",)]


def test_own_norm(spark):
    closes = []
    for k in range(24):
        closes += [100.0 + k] * 3 + [50.0 + k]
    closes += [7.0] * 9
    assert rows(feed.stale_runs(bars(spark, ("A", closes))), "n_bars") == [(9,)]


def stale_by_loop(bars, witness):
    out = []
    for sym in sorted({b[0] for b in bars if b[0]}):
        s, w = sorted(b[1:] for b in bars if b[0] == sym), sorted(b[1:] for b in witness if b[0] == sym and b[1])
        cuts = [0] + [i for i in range(1, len(s)) if s[i][1] != s[i - 1][1]] + [len(s)]
        runs = [(i, j - 1) for i, j in zip(cuts, cuts[1:], strict=False) if j - i > 1]
        lengths = sorted(j - i + 1 for i, j in runs)
        bar = max(3, lengths[min(len(lengths) - 1, int(0.99 * len(lengths)))]) if len(lengths) >= 20 else 3
        for i, j in runs:
            if j - i + 1 < bar:
                continue
            upto = lambda d: [c for t, c in w if t <= d][-1:]  # noqa: B023, E731
            b, e, inside = upto(s[max(i - 1, 0)][0]), upto(s[j][0]), [c for t, c in w if s[i][0] <= t <= s[j][0]]
            move = round(math.log(e[0] / b[0]), 9) if b and e else None
            moved = move is not None and (abs(move) > math.log(1.02) or bool(inside and max(inside) / min(inside) > 1.02))
            out.append((sym, s[i][0], s[j][0], j - i + 1, s[i][1], move, "UNVERIFIED" if move is None else "STALE_FEED" if moved else "ILLIQUID"))
    return out


def test_stale_runs_equal_a_plain_loop(spark):
    from pyspark.sql import functions as F

    r = random.Random(11)
    frozen, seen = [("TWO", day(0), 5.0), ("TWO", day(1), 5.0), ("NONE", day(0), 5.0), ("NONE", day(1), 5.0), ("NONE", day(2), 5.0), (None, day(0), 5.0), (None, day(1), 5.0), (None, day(2), 5.0)], [("TWO", day(0), 1.0), ("S1", None, 77.0)]
    for k, n in enumerate((30, 60, 120, 400, 800)):
        days = sorted(r.sample(range(n * 2), n))
        frozen += [(f"S{k}", day(d), 100.0 + (r.randrange(2) if k % 2 else r.choice([0, 0, 0, 1]))) for d in days]
        seen += [(f"S{k}", day(d), 50.0 * math.exp(r.gauss(0, 0.008))) for d in range(10, n * 2) if r.random() < 0.4]
    tape = lambda rs: spark.createDataFrame(rs, "symbol string, date date, close double").repartition(3)
    cols = ("symbol", "start", "end", "n_bars", "close", "witness_move", "classification")
    key = lambda x: x[:2]
    got = feed.stale_runs(tape(frozen), tape(seen)).withColumn("witness_move", F.round("witness_move", 9))
    want = stale_by_loop(frozen, seen)
    assert {x[-1] for x in want} == {"STALE_FEED", "ILLIQUID", "UNVERIFIED"}
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(want, key=key)
    alone = sorted(map(tuple, feed.stale_runs(tape(frozen)).select(*cols).collect()), key=key)
    assert alone == [(*x[:5], None, "UNVERIFIED") for x in sorted(want, key=key)]


def test_stale_runs_sort_each_tape_once(spark, tmp_path):
    """What a task holds is one sort of a tape, and the runs: neither tape is read, exchanged or sorted twice."""
    for name in ("tape", "witness"):
        bars(spark, ("A", walk(30))).select("symbol", "date", "close").write.parquet(f"{tmp_path}/{name}")
    got = feed.stale_runs(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("tape", "witness")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the third sort is of the runs by their length
    assert (plan.count("FileScan"), plan.count("Exchange hashpartitioning"), plan.count(" Sort [")) == (2, 2, 3)


@pytest.mark.parametrize("late", [1, -1])
def test_shifts(spark, late):
    w = walk(300, 4, 0.02)
    p = list(w)
    p[100:160] = [w[i - late] for i in range(100, 160)]
    got = rows(feed.date_shifts(bars(spark, ("A", p)), bars(spark, ("A", w))), "shift", "start", "end")
    assert [r[0] for r in got] == [late]
    assert abs((got[0][1] - day(100)).days) <= 15
    assert feed.date_shifts(bars(spark, ("A", w)), bars(spark, ("A", w))).count() == 0


# -- reconcile --------------------------------------------------------------------------------------------------------
def series(spark, *pairs):
    rs = [(s, day(i), float(f)) for s, fs in pairs for i, f in enumerate(fs)]
    return spark.createDataFrame(rs, "symbol string, date date, factor double")


@pytest.mark.parametrize(
    ("ours", "ref", "kind"),
    [
        ([1] * 5 + [4] * 5, [1] * 5 + [4] * 5, "EXACT"),
        ([1] * 5 + [4] * 5, [1.01] * 5 + [4.04] * 5, "MINOR"),
        ([1] * 5 + [4] * 5, [2] * 5 + [8] * 5, "EXACT_ADJUSTED_EQUIV"),
        ([0.1] * 50 + [1] * 50, [0.1] * 55 + [1] * 45, "DATE_DIFFERS"),
        ([0.1] * 50 + [1] * 50, [1] * 100, "MISMATCH"),
        ([0.1] * 50 + [1] * 50, [0.2] * 50 + [1] * 50, "MISMATCH"),
        ([1] * 3, [1] * 3, "NOT_COMPARABLE"),
    ],
)
def test_reconcile(spark, ours, ref, kind):
    r = reconcile.reconcile(series(spark, ("A", ours)), series(spark, ("A", ref))).first()
    assert r.classification == kind


def test_reconcile_one_side_and_explained(spark):
    why = spark.createDataFrame([("A", "no spin-offs")], "symbol string, explanation string")
    got = reconcile.reconcile(series(spark, ("A", [0.1] * 9 + [1] * 9), ("B", [1] * 9)), series(spark, ("A", [1] * 18)), why)
    assert rows(got, "symbol", "classification") == [("A", "EXPLAINED"), ("B", "NOT_COMPARABLE")]
    g = reconcile.gate(got).first()
    assert (g.n_total, g.n_comparable, g.n_passing, g.gate_passed) == (2, 1, 1, True)
    assert reconcile.gate(got.limit(0)).first().pass_rate == 1.0


def test_reconcile_sparse(spark):
    sparse = spark.createDataFrame([("A", day(0), 0.1), ("A", day(5), 1.0)], "symbol string, date date, factor double")
    assert reconcile.reconcile(sparse, series(spark, ("A", [0.1] * 5 + [1] * 5))).first().classification == "EXACT"


# -- identity ---------------------------------------------------------------------------------------------------------
def history(spark, *rs):
    return spark.createDataFrame(list(rs), "security_id string, symbol string, valid_from date, valid_to date")


def test_identity(spark):
    h = history(spark, ("ID1", "T", day(0), day(4)), ("ID2", "T", day(6), None))
    b = bars(spark, ("T", [1.0] * 10), ("U", [2.0]))
    got = identity.rekey_by_security(b, h)
    assert rows(got, "symbol", "date", "ticker")[:5] == [("ID1", day(i), "T") for i in range(5)]
    assert rows(got.filter("symbol = 'T'"), "date") == [(day(5),)]
    assert identity.rekey_by_security(b, h, unmatched="drop").count() == 9
    with pytest.raises(Exception, match="no symbol-history"):
        identity.rekey_by_security(b, h, unmatched="raise").collect()
    with pytest.raises(ValueError, match="unmatched"):
        identity.rekey_by_security(b, h, unmatched="x")
    assert rows(identity.security_bars(b, h).groupBy("symbol").count(), "symbol", "count") == [("ID1", 5), ("ID2", 4), ("U", 1)]
    with pytest.raises(ValueError, match="overlap"):
        identity.validate_history(history(spark, ("A", "T", day(0), day(5)), ("B", "T", day(5), None)))
    with pytest.raises(ValueError, match="inverted"):
        identity.validate_history(history(spark, ("A", "T", day(5), day(0))))
    assert identity.validate_history(h) is h
    assert identity.symbol_history(spark, [("A", "T", day(0), None)]).count() == 1


# -- sources ----------------------------------------------------------------------------------------------------------
def test_sources(spark, tmp_path):
    b = R.bars_from_memory(spark, {"7203": [(day(0), 1.0, 2.0, 0.5, 1.5, 9)], "A": [(day(1), 1.0, 2.0, 0.5, 1.5, 9)]})
    R.write_by_symbol(b, str(tmp_path / "hive"))
    back = R.bars_from_parquet(spark, str(tmp_path / "hive"))
    assert rows(back, "symbol", "date", "volume") == [("7203", day(0), 9), ("A", day(1), 9)]
    b.coalesce(1).write.parquet(str(tmp_path / "one"))
    assert R.bars_from_parquet(spark, str(tmp_path / "one")).filter("symbol = 'A'").count() == 1
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "BRK.csv").write_text("date,open,high,low,close,volume\n2023-01-03,1,2,0.5,1.5,10\n2023-01-02,1,2,0.5,1,10\n")
    assert rows(R.bars_from_csv(spark, str(tmp_path / "csv")), "symbol", "date", "close") == [("BRK", dt.date(2023, 1, 2), 1.0), ("BRK", dt.date(2023, 1, 3), 1.5)]
    (tmp_path / "c.csv").write_text("symbol,date,ratio_from,ratio_to\nA,2023-01-03,1,1.0526\n")
    assert rows(R.claims_from_csv(spark, str(tmp_path / "c.csv")), "symbol", "ratio_to", "source") == [("A", 1.0526, None)]
    spark.createDataFrame([("A", day(0), 1, 4)], "symbol string, date date, ratio_from int, ratio_to int").write.parquet(str(tmp_path / "c"))
    assert rows(R.claims_from_parquet(spark, str(tmp_path / "c")), "ratio_from", "type") == [(1.0, None)]
    for fn in (R.bars_from_csv, R.bars_from_parquet, R.claims_from_csv, R.claims_from_parquet):
        assert fn(spark, str(tmp_path / "none")).count() == 0
    assert rows(R.symbols_of(back), "symbol") == [("7203",), ("A",)]


def test_csv_columns_are_matched_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "A.csv").write_text("date,open,high,low,close,volume\n2023-01-02,1,4,0.5,2,10\n")
    (tmp_path / "B+C.csv").write_text("date,close,open,high,low\n2023-01-02,2,1,4,0.5\n")
    (tmp_path / "D 50%25.csv").write_text("Close, Date\nx,2023-01-02\n")
    got = rows(R.bars_from_csv(spark, str(tmp_path)), "symbol", "open", "high", "low", "close", "volume")
    assert got == [("A", 1.0, 4.0, 0.5, 2.0, 10), ("B+C", 1.0, 4.0, 0.5, 2.0, None), ("D 50%25", None, None, None, None, None)]
    (tmp_path / "E.csv").write_text("date,close,close\n2023-01-02,2,1\n")
    with pytest.raises(ValueError, match="twice"):
        R.bars_from_csv(spark, str(tmp_path))


# -- gauntlet ---------------------------------------------------------------------------------------------------------
def test_gauntlet_meets_every_floor(spark):
    from tapeline.plans.gauntlet import scorecard

    got = scorecard(spark, GauntletSettings(n_instances_per_class=3, n_clean_symbols=4), rounds=3).collect()
    assert len(got) == 23
    assert [r["class"] for r in got if not r["met"]] == []


def test_vintage_keeps_real_claims_over_adjusted_tapes(spark):
    from tapeline.plans.gauntlet import vintage_query

    assert rows(vintage_query(spark, ""), "vintage", "survived", "n") == [("with", 6, 6), ("without", 0, 6)]


def test_entry_and_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
