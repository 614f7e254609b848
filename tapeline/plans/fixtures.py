"""A price tape derived from the driver's tables, as the same SQL for Spark and for the oracle.

The tables hold no prices, so supplier shipments give sessions and formulas give prices, with planted splits, provider
breaks, frozen and shifted spans. ``{D}`` marks a double literal.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tapeline.functions.scratch import materialize

_M = "cast(100000 + ((m*37 + sk*11) % 21 - 10) * 100 as double) / 1000.0"
_X8 = "case when sk % 5 = 2 and n >= 300 and n < 330 then {8.0} else {1.0} end"

#: name -> (what it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_sessions": (("lineitem",), "select l_suppkey as sk, cast(l_shipdate as date) as date, cast(row_number() over (partition by l_suppkey order by cast(l_shipdate as date)) as bigint) as n from (select distinct l_suppkey, cast(l_shipdate as date) as l_shipdate from lineitem) t"),
    "fx_witness": (("fx_sessions",), "select concat('S', cast(sk as varchar(20))) as symbol, sk, n, date, cast(100000 + ((n*37 + sk*11) % 21 - 10) * 100 as double) / 1000.0 * case when sk % 4 = 0 and n >= 200 then {0.1} when sk % 4 = 1 and n >= 200 then {10.0} else {1.0} end as close from fx_sessions"),
    "fx_bars": (("fx_witness",), f"select symbol, sk, n, date, close * {_X8} as close, close * {_X8} as open, close * {_X8} * case when (n + sk) % 97 = 0 then {{2.5}} else {{1.01}} end as high, close * {_X8} * case when (n + sk) % 89 = 0 then {{0.4}} else {{0.99}} end as low, cast(1000 + (n*13 + sk*7) % 500 as bigint) as volume from fx_witness"),
    "fx_claims": (("fx_bars",), """
        select symbol, date, case when sk % 4 = 0 then {1.0} else {10.0} end as ratio_from, case when sk % 4 = 0 then {10.0} else {1.0} end as ratio_to, 'price_feed' as source, 'split' as type, sk*10+1 as rid from fx_bars where n = 200 and sk % 4 in (0,1)
        union all select symbol, date, case when sk % 4 = 0 then {1.0} else {10.0} end, case when sk % 4 = 0 then {10.0} else {1.0} end, 'filing_feed', 'split', sk*10+2 from fx_bars where n = 203 and sk % 4 in (0,1)
        union all select symbol, date, {10.0}, {1.0}, 'text_feed', 'reverse_split', sk*10+3 from fx_bars where n = 200 and sk % 8 = 0
        union all select symbol, date, {1.0}, {4.0}, 'misparsed_feed', 'split', sk*10+4 from fx_bars where n = 400 and sk % 3 = 0
        union all select symbol, date, {2.0}, {3.0}, 'misparsed_feed', 'split', sk*10+5 from fx_bars where n = 100 and sk % 7 = 0
        union all select symbol, cast(date + interval '400' day as date), {1.0}, {5.0}, 'stale_feed', 'split', sk*10+6 from fx_bars where n = 450 and sk % 6 = 0
        union all select symbol, date, {1000.0}, {1.0}, 'v', 'reverse_split', sk*10+7 from fx_bars where n = 50 and sk % 9 = 0
        union all select symbol, date, {1.0}, {1000.0}, 'v', 'forward_split', sk*10+8 from fx_bars where n = 50 and sk % 9 = 0"""),
    "fx_ticks": (("events",), "select concat('U', cast(user_id as varchar(20))) as symbol, event_id, ts, value + {1.0} as price from events"),
    "fx_truth": (("fx_ticks",), "select symbol, cast(ts as date) as date, max(price) as truth_high, min(price) as truth_low, count(*) as truth_n from fx_ticks group by symbol, cast(ts as date)"),
    # daily bars of the ticks' symbols: first and last price, with planted bad highs, lows and opens
    "fx_tick_bars": (("fx_ticks",), """
        select symbol, date, o * case when k % 11 = 0 then {2.1} else {1.0} end as open, h * case when k % 5 = 0 then {2.5} when k % 13 = 0 then {1.03} else {1.0} end as high,
        l * case when k % 7 = 0 then {0.4} when k % 13 = 1 then {0.97} else {1.0} end as low, c as close, k as volume
        from (select symbol, cast(ts as date) as date, min_by(price, ts) as o, max(price) as h, min(price) as l, max_by(price, ts) as c, sum(event_id % 97) as k from fx_ticks group by symbol, cast(ts as date)) t"""),
    "fx_tick_claims": (("fx_ticks",), "select symbol, cast(min(cast(ts as date)) + interval '5' day as date) as date, {1.0} as ratio_from, {4.0} as ratio_to, 'feed' as source, 'split' as type, min(event_id) as rid from fx_ticks group by symbol"),
    "fx_frozen": (("fx_bars",), f"select symbol, date, n, {_M} as close from (select symbol, sk, date, n, case when n % 40 between 1 and 5 and n > 40 and sk % 3 <> 0 then n - n % 40 else n end as m from fx_bars) x"),
    "fx_calm": (("fx_bars",), f"select symbol, date, n, {_M} as close from (select symbol, sk, date, n, n as m from fx_bars) x"),
    "fx_shifted": (("fx_bars",), f"select symbol, date, n, {_M} as close from (select symbol, sk, date, n, case when n between 250 and 309 and sk % 2 = 0 then n - 1 when n between 250 and 309 and sk % 4 = 1 then n + 1 else n end as m from fx_bars) x"),
    "fx_history": (("fx_bars",), "select concat('ID', cast(sk as varchar(20)), '_A') as security_id, concat('S', cast(sk as varchar(20))) as symbol, min(date) as valid_from, max(case when n <= 150 then date end) as valid_to from fx_bars where sk % 2 = 0 group by sk union all select concat('ID', cast(sk as varchar(20)), '_B'), concat('S', cast(sk as varchar(20))), min(case when n >= 170 then date end), cast(null as date) from fx_bars where sk % 2 = 0 group by sk"),
    "fx_overlaps": (("fx_history",), "select security_id, symbol, valid_from, case when security_id like '%4_A' then cast(null as date) else valid_to end as valid_to from fx_history"),
    # two adjustment histories: ours has one event more for some symbols, a later date for others, another level for others
    "fx_ours": (("fx_bars",), "select symbol, date, case when n < 200 then {0.1} else {1.0} end * case when sk % 7 = 3 and n < 300 then {0.5} else {1.0} end as factor from fx_bars"),
    "fx_reference": (("fx_bars",), "select symbol, date, case when n < 200 + case when sk % 5 = 1 then 4 else 0 end then {0.1} else {1.0} end * case when sk % 6 = 2 then {2.0} when sk % 6 = 4 then {1.01} else {1.0} end as factor from fx_bars where sk % 11 <> 0"),
}


def _text(sql: str, duck: bool) -> str:
    import re

    return re.sub(r"\{([\d.]+)\}", (lambda m: f"cast({m[1]} as double)") if duck else (lambda m: f"{m[1]}D"), sql)


def needs(*names: str) -> list[str]:
    """The views that ``names`` read, in the order they must be made, ``names`` included."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in out:
            for x in VIEWS[n][0]:
                visit(x)
            out.append(n)

    for n in names:
        visit(n)
    return out


def duck_ctes(*names: str) -> str:
    return ",\n".join(f"{n} AS MATERIALIZED ({_text(VIEWS[n][1], True)})" for n in needs(*names))


@cache
def _made(app: str, sf_dir: str) -> dict[str, DataFrame]:
    return {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a table in the shared folder, made once for each session and folder."""
    made = _made(spark.sparkContext.applicationId, sf_dir)
    if name not in made:
        if name not in VIEWS:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            reads, sql = VIEWS[name]
            text = _text(sql, False)
            for r in reads:
                text = text.replace(f"from {r}", f"from {{{r}}}")
            made[name] = materialize(spark.sql(text, **{r: fixture(spark, sf_dir, r) for r in reads}))
    return made[name]
