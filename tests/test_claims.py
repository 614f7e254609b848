import datetime as dt

import pytest
from tape import bars, day, rows

from tapeline.functions.tape import bars_with_neighbours, local_tape, unique_boundaries, with_own_gap
from tapeline.operators import claims as C
from tapeline.settings import ChainSettings
from tapeline.sources.readers import claims_from_memory

KEY = ("symbol", "date", "ratio_from", "ratio_to")
S = ChainSettings(source_priority=("tape_confirmed", "price_feed"))


def claims(spark, *rs):
    return claims_from_memory(spark, rs)


def near(spark, closes):
    return bars_with_neighbours(bars(spark, ("A", closes)))


@pytest.mark.parametrize(
    ("days", "left"), [((0, 4, 9), 1), ((0, 1400), 2), ((0, 140, 280), 2)]
)
def test_duplicates_are_anchored_to_the_first_row(spark, days, left):
    c = claims(spark, *[("A", day(d), 1, 4, "x") for d in days])
    assert C.collapse_duplicates(c).kept.count() == left


def test_duplicates_confirmed_apart_stay_two(spark):
    tape = near(spark, [1.0] * 100 + [10.0] * 90 + [100.0] * 60)
    c = claims(spark, ("A", day(100), 10, 1), ("A", day(190), 10, 1))
    assert C.collapse_duplicates(c, tape).kept.count() == 2


def test_duplicates_of_one_confirmed_event(spark):
    tape = near(spark, [1.0] * 100 + [10.0] * 60)
    c = claims(spark, ("A", day(100), 10, 1), ("A", day(100), 10, 1), ("A", day(98), 10, 1))
    assert rows(C.collapse_duplicates(c, tape).kept, "date") == [(day(100),)]


def test_same_date(spark):
    c = claims(spark, ("A", day(10), 4, 1), ("A", day(10), 1, 4))
    assert rows(C.collapse_same_date(c, near(spark, [64.0] * 10 + [15.5] * 9)).kept, *KEY) == [("A", day(10), 1.0, 4.0)]
    assert rows(C.collapse_same_date(claims(spark, ("A", day(1), 1, 1), ("A", day(1), 1, 4))).kept, "ratio_to") == [(4.0,)]


def test_near_date(spark):
    tape = near(spark, [10.0] * 10 + [100.0] * 10)
    c = claims(spark, ("A", day(10), 10, 1), ("A", day(14), 30, 1))
    assert rows(C.collapse_near_date(c, tape).kept, "ratio_from") == [(10.0,)]
    assert C.collapse_near_date(claims(spark, ("A", day(0), 20, 1), ("A", day(43), 15, 1))).kept.count() == 2


def test_post_coverage(spark):
    b = bars(spark, ("A", [1.0] * 5))
    done = C.drop_post_coverage(claims(spark, ("A", day(405), 1, 10), ("A", day(4), 1, 2), ("B", day(405), 1, 10)), b)
    assert rows(done.kept, "symbol", "ratio_to") == [("A", 2.0), ("B", 10.0)]
    assert rows(done.audit, "stage", "decision") == [("post_coverage", "dropped")]


def test_mislabels(spark):
    cited = spark.createDataFrame([("A", day(3), 1, 2, "spin-off")], "symbol string, date date, ratio_from int, ratio_to int, citation string")
    done = C.drop_recorded_mislabels(claims(spark, ("A", day(3), 1, 2), ("A", day(4), 1, 2)), cited)
    assert rows(done.kept, "date") == [(day(4),)]


def test_composite(spark):
    kept = C.compose_same_day_legs(claims(spark, ("A", day(1), 1000, 1, "v"), ("A", day(1), 1, 1000, "v"))).kept
    assert rows(kept, "ratio_from", "ratio_to", "type") == [(1000.0, 1000.0, "composite")]
    kept = C.compose_same_day_legs(claims(spark, ("A", day(1), 10, 1, "v"), ("A", day(1), 1, 2, "v"))).kept
    assert rows(kept, "ratio_from", "ratio_to") == [(10.0, 2.0)]
    for legs in ([("A", day(1), 10, 1, "v"), ("A", day(1), 750, 1, "v")], [("A", day(1), 10, 1), ("A", day(1), 1, 2)]):
        assert C.compose_same_day_legs(claims(spark, *legs)).kept.count() == 2
    tape = near(spark, [48.0] * 10 + [12.5] * 8)
    done = C.compose_same_day_legs(claims(spark, ("A", day(10), 1, 4, "v"), ("A", day(10), 4, 1, "v"), ("A", day(3), 7, 1, "v"), ("A", day(3), 9, 1, "v"), ("A", day(5), 7, 1, "v"), ("A", day(5), 1, 7, "v")), tape)
    assert done.kept.count() == 5
    assert rows(C.stage_totals(done.audit), "decision", "n") == [("composed", 2), ("left_as_conflict", 4)]


def test_snap(spark):
    b = bars(spark, ("A", [88.0] * 20 + [22.0] * 17))
    assert rows(C.snap_to_tape(claims(spark, ("A", day(22), 1, 4)), b).kept, "date") == [(day(20),)]
    assert rows(C.snap_to_tape(claims(spark, ("A", day(22), 10, 9)), b).kept, "date") == [(day(22),)]


@pytest.mark.parametrize(
    ("closes", "found"),
    [([72.0] * 10 + [18.5] * 7, [day(10)]), ([72.0] * 10 + [18.0, 70.0] + [71.0] * 6, []), ([72.0] * 8 + [18.0] * 3 + [4.6] * 7, []), ([72.0] * 10 + [18.0], [])],
)
def test_unique_boundary(spark, closes, found):
    got = unique_boundaries(claims(spark, ("A", day(10), 1, 4)), bars(spark, ("A", closes)))
    assert [r[0] for r in rows(got, "tape_date")] == found


def test_phantom_and_vintage(spark):
    tape, c = near(spark, [100.0] * 20), claims(spark, ("A", day(10), 1, 3))
    assert C.refute_phantoms(c, tape).kept.count() == 0
    v = spark.createDataFrame([("A", day(10), "ADJUSTED")], "symbol string, date date, vintage string")
    assert C.refute_phantoms(c, tape, v).kept.count() == 1
    far = claims(spark, ("A", day(90), 1, 3))
    assert rows(C.refute_phantoms(far, tape).audit, "decision") == [("unmeasurable_kept",)]


def test_gap_leaves_out_the_day_itself(spark):
    tape = near(spark, [10.0, 10.0, 10.0, 7.0, 40.0, 44.0, 42.0])
    got = with_own_gap(claims(spark, ("A", day(3), 1, 4), ("A", day(0), 1, 4), ("B", day(1), 1, 4)), tape)
    assert rows(got.fillna(0.0, ["gap"]), "symbol", "date", "gap") == [("A", day(0), 0.0), ("A", day(3), 4.2), ("B", day(1), 0.0)]


def test_chain_is_idempotent(spark):
    b = bars(spark, ("A", [100.0] * 40 + [25.0] * 40))
    c = claims(spark, ("A", day(40), 1, 4, "price_feed"), ("A", day(45), 1, 4, "text"), ("A", day(40), 4, 1, "text"), ("A", day(60), 1, 3, "text"), ("A", day(700), 1, 5, "text"))
    once = C.collapse_all(c, b, s=S)
    assert rows(once.kept, *KEY) == [("A", day(40), 1.0, 4.0)]
    assert rows(C.collapse_all(once.kept, b, s=S).kept, *KEY) == rows(once.kept, *KEY)
    assert {r[0] for r in rows(once.audit, "stage")} >= {"post_coverage", "duplicate", "same_date", "phantom"}


def test_empty(spark):
    assert C.collapse_all(claims(spark), bars(spark, ("A", [1.0] * 5))).kept.count() == 0


def test_dates(spark):
    assert day(0) == dt.date(2023, 1, 2)


def test_chain_without_a_tape_goes_by_its_rules(spark):
    c = claims(spark, ("A", day(1), 1, 2, "x"), ("A", day(4), 1, 2, "price_feed"), ("B", day(900), 1, 3, "x"), ("B", day(900), 3, 3, "x"), ("C", day(2), 1, 30, "x"))
    done = C.collapse_all(c, s=S)
    assert rows(done.kept, *KEY) == [("A", day(4), 1.0, 2.0), ("B", day(900), 1.0, 3.0), ("C", day(2), 1.0, 30.0)]
    assert rows(done.audit, "stage", "decision") == [("duplicate", "collapsed"), ("same_date", "collapsed")]


def test_local_tape_measures_as_the_whole_tape_does(spark):
    """Sparse symbols, claims at both ends of the tape and beyond it."""
    series = [("A", [10.0 + i % 7 for i in range(300)]), ("B", [5.0, 6.0]), ("C", [1.0 + i for i in range(40)])]
    b = bars(spark, *series)
    thin = b.filter("symbol != 'A' or date_format(date, 'D') % 40 = 1")
    c = claims(spark, *[(s, day(d), 1, 4) for s in "ABCX" for d in (0, 1, 40, 41, 120, 299, 310, 700)])
    for tape in (b, thin):
        whole = rows(with_own_gap(c, bars_with_neighbours(tape)), "rid", "gap")
        assert rows(with_own_gap(c, bars_with_neighbours(local_tape(c, tape))), "rid", "gap") == whole
        assert rows(unique_boundaries(c, local_tape(c, tape)), "rid", "tape_date") == rows(unique_boundaries(c, tape), "rid", "tape_date")
    assert local_tape(c.filter("date > '2024-06-01'"), b).count() == b.count()  # far claims see whole symbols
