"""Oracle SQL for DuckDB, written from the semantics and apart from the Spark operators.

Stages of the claims chain are functions from one CTE name to the CTEs of the next, so that the whole chain has an
oracle as well.
"""

from __future__ import annotations

from tapeline.plans.fixtures import duck_ctes

LN15, LN2, LN135, LN12, LN16, LN102, LN101, LN1001 = (f"ln(CAST({x} AS DOUBLE))" for x in ("1.5", "2.0", "1.35", "1.2", "1.6", "1.02", "1.01", "1.001"))
CLAIM = "symbol, date, ratio_from, ratio_to, source, type, rid"


def gap(ask: str, out: str, key: str = "rid", bars: str = "fx_bars") -> str:
    """CTE ``out`` (key, gap) for ``ask`` (key, symbol, first, last)."""
    return f"""{out} AS MATERIALIZED (
  SELECT a.{key}, CASE WHEN b.m > 0 AND c.m > 0 AND date_diff('day', b.d, a.first) <= 10 AND date_diff('day', a.last, c.d) <= 10 THEN c.m / b.m END AS gap
  FROM {ask} a
  LEFT JOIN LATERAL (SELECT median(close) AS m, max(date) AS d FROM (SELECT close, date FROM {bars} x WHERE x.symbol = a.symbol AND x.date < a.first ORDER BY date DESC LIMIT 3) y) b ON true
  LEFT JOIN LATERAL (SELECT median(close) AS m, min(date) AS d FROM (SELECT close, date FROM {bars} x WHERE x.symbol = a.symbol AND x.date > a.last ORDER BY date LIMIT 3) y) c ON true)"""


def own_gap(src: str, out: str) -> str:
    return f"{out}_ask AS (SELECT rid, symbol, date AS first, date AS last FROM {src}),\n" + gap(f"{out}_ask", out)


def post_coverage(src: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT c.* FROM {src} c LEFT JOIN (SELECT symbol, max(date) AS last_bar FROM fx_bars GROUP BY symbol) l USING (symbol) WHERE last_bar IS NULL OR date <= last_bar)"


def composite(src: str, out: str) -> str:
    g = f"{out}_g"
    return f"""{g} AS MATERIALIZED (
  SELECT symbol, date, source, min(rid) AS rid, product(ratio_from) AS pf, product(ratio_to) AS pt, list(ln(ratio_from / ratio_to)) AS legs, list(rid) AS rids, date AS first, date AS last
  FROM {src} WHERE source IS NOT NULL AND ratio_from <> ratio_to GROUP BY symbol, date, source
  HAVING count(*) > 1 AND count(DISTINCT (round(ratio_from, 12), round(ratio_to, 12))) > 1 AND bool_or(ratio_from > ratio_to) AND bool_or(ratio_from < ratio_to)),
{gap(g, f"{out}_gap")},
{out}_c AS MATERIALIZED (SELECT {g}.* FROM {g} JOIN {out}_gap USING (rid) WHERE NOT coalesce(abs(ln(gap) - ln(pf / pt)) > {LN15} AND len(list_filter(legs, lambda x: abs(ln(gap) - x) <= {LN15})) > 0, false)),
{out} AS MATERIALIZED (
  SELECT {CLAIM} FROM {src} WHERE rid NOT IN (SELECT unnest(rids) FROM {out}_c)
  UNION ALL SELECT s.symbol, s.date, c.pf, c.pt, s.source, 'composite', s.rid FROM {src} s JOIN {out}_c c USING (rid))"""


def duplicates(src: str, out: str) -> str:
    """Anchored blocks of 150 days by recursion, then anchors within them, then the nearest anchor."""
    k = "symbol, ratio_from, ratio_to"
    same = "{a}.symbol = {b}.symbol AND {a}.ratio_from = {b}.ratio_from AND {a}.ratio_to = {b}.ratio_to"
    return f"""{own_gap(src, f"{out}_gap")},
{out}_r AS MATERIALIZED (SELECT s.*, coalesce(abs(ln(gap) - ln(ratio_from / ratio_to)) <= {LN15}, false) AS ok FROM {src} s JOIN {out}_gap USING (rid)),
{out}_b AS (
  SELECT {k}, min(date) AS start FROM {out}_r GROUP BY {k}
  UNION ALL
  SELECT {", ".join("p." + c.strip() for c in k.split(","))}, (SELECT min(r.date) FROM {out}_r r WHERE {same.format(a="r", b="p")} AND r.date > p.start + 150) FROM {out}_b p
  WHERE EXISTS (SELECT 1 FROM {out}_r r WHERE {same.format(a="r", b="p")} AND r.date > p.start + 150)),
{out}_rb AS MATERIALIZED (SELECT r.*, (SELECT max(b.start) FROM {out}_b b WHERE {same.format(a="b", b="r")} AND b.start <= r.date) AS block FROM {out}_r r),
{out}_a AS (
  SELECT {k}, block, min(date) AS anchor FROM {out}_rb WHERE ok GROUP BY {k}, block
  UNION ALL
  SELECT {", ".join("p." + c.strip() for c in k.split(","))}, p.block, (SELECT min(r.date) FROM {out}_rb r WHERE {same.format(a="r", b="p")} AND r.block = p.block AND r.ok AND r.date > p.anchor + 10) FROM {out}_a p
  WHERE EXISTS (SELECT 1 FROM {out}_rb r WHERE {same.format(a="r", b="p")} AND r.block = p.block AND r.ok AND r.date > p.anchor + 10)),
{out}_n AS MATERIALIZED (SELECT r.*, (SELECT arg_min(a.anchor, abs(date_diff('day', a.anchor, r.date)) * 100000 + date_diff('day', DATE '1900-01-01', a.anchor)) FROM {out}_a a WHERE {same.format(a="a", b="r")} AND a.block = r.block) AS near FROM {out}_rb r),
{out} AS MATERIALIZED (SELECT {CLAIM} FROM (SELECT *, row_number() OVER (PARTITION BY {k}, block, near ORDER BY CASE WHEN source = 'price_feed' THEN 1 WHEN source = 'tape_confirmed' THEN 0 ELSE 2 END, date DESC, rid) AS pick FROM {out}_n) WHERE pick = 1)"""


RANK = "CASE WHEN source = 'tape_confirmed' THEN 0 WHEN source = 'price_feed' THEN 1 ELSE 2 END"


def _pick(src: str, out: str, group: str, order: str) -> str:
    return f"""{out}_g AS (SELECT {group}, min(rid) AS rid, any_value(symbol) AS symbol_, min(date) AS first, max(date) AS last, count(*) AS n FROM {src} GROUP BY {group}),
{out}_ask AS (SELECT rid, symbol_ AS symbol, first, last FROM {out}_g WHERE n > 1),
{gap(f"{out}_ask", f"{out}_gap")},
{out}_e AS MATERIALIZED (SELECT s.*, n, abs(ln(gap) - ln(ratio_from / ratio_to)) AS err FROM {src} s JOIN {out}_g g USING ({group}) LEFT JOIN {out}_gap p ON p.rid = g.rid),
{out}_p AS (SELECT *, min(err) OVER (PARTITION BY {group}) AS least, row_number() OVER (PARTITION BY {group} ORDER BY err NULLS LAST, rid) AS fit, row_number() OVER (PARTITION BY {group} ORDER BY {order}, rid) AS best FROM {out}_e),
{out} AS MATERIALIZED (SELECT {CLAIM} FROM {out}_p WHERE CASE WHEN coalesce(least <= {LN15}, false) THEN fit = 1 ELSE best = 1 END)"""


def same_date(src: str, out: str) -> str:
    return _pick(src, out, "symbol, date", f"ratio_from = ratio_to, {RANK}, abs(ln(ratio_to / ratio_from)) DESC")


def near_date(src: str, out: str) -> str:
    i = f"{out}_i"
    return f"""{i} AS MATERIALIZED (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY date, rid ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN coalesce(date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date, rid), date) > 10, true) THEN 1 ELSE 0 END AS fresh FROM {src})),
{_pick(i, out, "symbol, island", f"ratio_from = ratio_to, {RANK}, date DESC")}"""


MOVES = """moves AS MATERIALIZED (SELECT symbol, date, close / nullif(lag(close) OVER w, 0) AS r, lead(close) OVER w / nullif(close, 0) AS r_next FROM fx_bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def boundaries(src: str, out: str) -> str:
    return f"""{MOVES.replace("moves", out + "_moves", 1)},
{out} AS MATERIALIZED (
  SELECT rid, any_value(date) AS tape_date, any_value(r) AS r FROM (
    SELECT c.rid, m.date, m.r, m.r_next, ln(c.ratio_from / c.ratio_to) AS implied FROM {src} c JOIN {out}_moves m ON m.symbol = c.symbol AND m.date BETWEEN c.date - 15 AND c.date + 7
    WHERE m.r > 0 AND c.ratio_from > 0 AND c.ratio_to > 0 AND abs(ln(m.r) - ln(c.ratio_from / c.ratio_to)) < {LN135}) t
  GROUP BY rid HAVING count(*) = 1 AND any_value(r_next) > 0 AND NOT (ln(any_value(r_next)) * any_value(implied) < 0 AND abs(ln(any_value(r_next))) > 0.5 * abs(any_value(implied))))"""


def snap(src: str, out: str) -> str:
    return f"""{boundaries(f"(SELECT * FROM {src} WHERE abs(ln(ratio_from / ratio_to)) >= {LN2})", f"{out}_b")},
{out} AS MATERIALIZED (SELECT s.symbol, coalesce(b.tape_date, s.date) AS date, ratio_from, ratio_to, source, type, s.rid FROM {src} s LEFT JOIN {out}_b b USING (rid))"""


def phantoms(src: str, out: str) -> str:
    return f"""{own_gap(src, f"{out}_gap")},
{out} AS MATERIALIZED (SELECT {CLAIM} FROM {src} JOIN {out}_gap USING (rid) WHERE NOT coalesce(abs(ln(ratio_from / ratio_to)) >= {LN2} AND abs(ln(gap)) < {LN12} AND abs(ln(gap) - ln(ratio_from / ratio_to)) > {LN2}, false))"""


def _q(views: tuple[str, ...], ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([duck_ctes(*views), *ctes]) + "\n" + select


_OUT = "SELECT symbol, date, ratio_from, ratio_to, source, type, CAST(rid AS BIGINT) AS rid FROM"
_TAPE = ("fx_claims", "fx_bars")
EVENTS = "ev AS (SELECT symbol, date, product(ratio_from / ratio_to) AS m FROM fx_claims GROUP BY symbol, date)"
TOKYO = "CAST(timezone('{z}', timezone('UTC', ts)) AS DATE)"

#: Each close with what the jump scan looks at, by index within its symbol.
JUMPS = f"""idx AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS cnt, lag(date) OVER w AS prev_date, lead(date) OVER w AS next_date,
  ln(close / lag(close) OVER w) AS ret FROM fx_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
win AS MATERIALIZED (SELECT *, lead(ret) OVER w AS ret_next,
  list_sort(list_filter(list(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS trail,
  list_sort(list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS bef,
  list_sort(list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS aft FROM idx WINDOW w AS (PARTITION BY symbol ORDER BY date)),
big AS (SELECT *, trail[len(trail) // 2 + 1] AS mid FROM win WHERE cnt >= 8 AND abs(ret) >= {LN15}),
dev AS (SELECT *, list_sort(list_transform(trail, lambda x: abs(x - mid))) AS devs, ln(aft[len(aft) // 2 + 1] / bef[len(bef) // 2 + 1]) AS level FROM big),
zed AS (SELECT *, CASE WHEN len(trail) >= 10 AND devs[len(devs) // 2 + 1] > 0 THEN abs(ret) / (1.4826 * devs[len(devs) // 2 + 1]) ELSE CAST('Infinity' AS DOUBLE) END AS z FROM dev),
cand AS MATERIALIZED (SELECT symbol, date, prev_date, CASE WHEN abs(level - ret) <= {LN135} THEN level ELSE ret END AS shift, z, CASE WHEN abs(level - ret) > {LN135} THEN next_date END AS one_day_end
  FROM zed WHERE z >= 8 AND (abs(level - ret) <= {LN135} OR coalesce(abs(ret + ret_next) <= {LN135}, false)))"""


def move(src: str, out: str, prev: str, day: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT s.*, (SELECT arg_max(w.close, w.date) FROM fx_witness w WHERE w.symbol = s.symbol AND w.date <= s.{prev}) AS wb, (SELECT arg_min(w.close, w.date) FROM fx_witness w WHERE w.symbol = s.symbol AND w.date >= s.{day}) AS wa FROM {src} s)"""


def _guard(bars: str, truth: str | None, dense: int) -> str:
    t = f"LEFT JOIN {truth} t USING (symbol, date)" if truth else "LEFT JOIN (SELECT CAST(NULL AS DOUBLE) AS truth_high, CAST(NULL AS DOUBLE) AS truth_low, 0 AS truth_n) t ON true"
    return f"""g0 AS (SELECT b.symbol, b.date, b.open AS o, b.high AS h, b.low AS l, b.close AS c, truth_high AS th, truth_low AS tl, coalesce(truth_n, 0) AS tn FROM {bars} b {t}),
g1 AS (SELECT *, coalesce(tl > 0 AND th >= tl AND c > 0 AND c >= tl * 0.98 AND c <= th * 1.02, false) AS ok FROM g0),
g2 AS (SELECT *, c > 0 AND (o > 1.8 * c OR o < 0.55 * c) AS oob, ok AND coalesce(o >= tl * 0.98 AND o <= th * 1.02, false) AS oseen FROM g1),
g3 AS (SELECT *, CASE WHEN oob AND NOT oseen THEN c ELSE o END AS o2 FROM g2),
g4 AS (SELECT *, greatest(o2, c) AS top, least(o2, c) AS bot FROM g3),
g5 AS (SELECT *, ok AND coalesce(th <= 2.5 * top AND th >= top * 0.98, false) AS thok, ok AND coalesce(tl >= bot / 2.5 AND tl <= bot * 1.02, false) AS tlok,
  h < top * 0.9999 OR l > bot * 1.0001 AS broken, top > 0 AND h > 1.8 * top AS hfar, bot > 0 AND l < 0.55 * bot AS lfar,
  ok AND coalesce(abs(ln(h / th)) <= {LN102}, false) AS hseen, ok AND coalesce(abs(ln(l / tl)) <= {LN102}, false) AS lseen FROM g4),
g6 AS (SELECT *, thok AND tlok AND l > 0 AND coalesce(h / l > 2.0 AND h / l > 1.5 * (th / tl), false) AS wide, tn >= {dense} AND ok AS dense FROM g5),
g7 AS (SELECT *, broken OR ((hfar OR wide OR (dense AND thok AND h > 1.02 * th)) AND NOT hseen) AS fixh, broken OR ((lfar OR wide OR (dense AND tlok AND l < 0.98 * tl)) AND NOT lseen) AS fixl,
  (((hfar AND hseen) OR (lfar AND lseen)) AND NOT broken) OR (oob AND oseen) AS conf FROM g6),
g8 AS (SELECT *, CASE WHEN fixh AND thok THEN least(th, 1.8 * top) WHEN fixh THEN top ELSE h END AS h2, CASE WHEN fixl AND tlok THEN greatest(tl, 0.55 * bot) WHEN fixl THEN bot ELSE l END AS l2, (fixh AND thok) OR (fixl AND tlok) AS bytruth FROM g7),
g9 AS (SELECT *, greatest(o2, h2, c) AS h3, least(o2, l2, c) AS l3 FROM g8),
g AS (SELECT symbol, date, round(o2, 6) AS open, round(h3, 6) AS high, round(l3, 6) AS low, round(c, 6) AS close, CAST(o2 <> o OR h3 <> h OR l3 <> l AS INTEGER) AS bad_print_flag,
  CASE WHEN (o2 <> o OR h3 <> h OR l3 <> l) AND bytruth THEN 'truth' WHEN o2 <> o OR h3 <> h OR l3 <> l THEN 'envelope' WHEN conf THEN 'confirmed' END AS repair_source, CAST(conf AS INTEGER) AS confirmed_extreme FROM g9)"""


ALIGNED = """j0 AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date, a.factor AS a, b.factor AS b FROM fx_ours a FULL JOIN fx_reference b ON a.symbol = b.symbol AND a.date = b.date),
j1 AS (SELECT symbol, date, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM j0 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
j2 AS (SELECT *, ln(a) - ln(b) AS d, abs(ln(a) - lag(ln(a)) OVER w) > """ + LN101 + """ AS ea, abs(ln(b) - lag(ln(b)) OVER w) > """ + LN101 + """ AS eb FROM j1 WHERE a > 0 AND b > 0 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


EXPLAINED = f"""c0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM cand j
  WHERE NOT EXISTS (SELECT 1 FROM fx_claims c WHERE c.symbol = j.symbol AND j.one_day_end IS NULL AND abs(date_diff('day', c.date, j.date)) <= 15 AND abs(j.shift - ln(c.ratio_from / c.ratio_to)) <= {LN135})),
-- one candidate after the other: each takes the first later one that is free and undoes it
walk AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, false AS shown, CAST(NULL AS BIGINT) AS mate FROM c0
  UNION ALL
  SELECT symbol, i, CASE WHEN mate IS NULL THEN used ELSE list_append(used, mate) END, shown, mate FROM (
    SELECT x.symbol, x.i, w.used, NOT list_contains(w.used, x.i) AS shown,
      CASE WHEN x.one_day_end IS NULL AND NOT list_contains(w.used, x.i) THEN (SELECT min(y.i) FROM c0 y WHERE y.symbol = x.symbol AND y.i > x.i AND NOT list_contains(w.used, y.i) AND date_diff('day', x.date, y.date) <= 120 AND abs(x.shift + y.shift) <= {LN135}) END AS mate
    FROM walk w JOIN c0 x ON x.symbol = w.symbol AND x.i = w.i + 1) t)"""

STEPS = f"""lv AS MATERIALIZED (SELECT symbol, date, d, ln(a) - lag(ln(a)) OVER w AS sa, ln(b) - lag(ln(b)) OVER w AS sb FROM j2 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
eo AS MATERIALIZED (SELECT symbol, date, sa AS step, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM lv WHERE abs(sa) > {LN101}),
er AS MATERIALIZED (SELECT symbol, date, sb AS step, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM lv WHERE abs(sb) > {LN101}),
-- one of our events after the other takes the nearest free one of its size, else a free one of its day
mt AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS VARCHAR[]) AS said FROM lv
  UNION ALL
  SELECT t.symbol, t.k, CASE WHEN coalesce(near % 1000000, same) IS NULL THEN used ELSE list_append(used, coalesce(near % 1000000, same)) END,
    CASE WHEN near IS NOT NULL AND near < 1000000 THEN said
      WHEN near IS NOT NULL THEN list_append(said, concat('DATE_DIFFERS ours ', t.date, ' ref ', (SELECT date FROM er r WHERE r.symbol = t.symbol AND r.k = near % 1000000), ' x', printf('%.4f', exp(t.step))))
      WHEN same IS NOT NULL THEN list_append(said, concat('RATIO_DIFFERS ', t.date, ' ours x', printf('%.4f', exp(t.step)), ' ref x', printf('%.4f', exp((SELECT step FROM er r WHERE r.symbol = t.symbol AND r.k = same)))))
      ELSE list_append(said, concat('ONLY_OURS ', t.date, ' x', printf('%.4f', exp(t.step)))) END
  FROM (SELECT x.symbol, x.k, x.date, x.step, m.used, m.said,
      (SELECT min(abs(date_diff('day', r.date, x.date)) * 1000000 + r.k) FROM er r WHERE r.symbol = x.symbol AND NOT list_contains(m.used, r.k) AND abs(r.step - x.step) <= {LN102} AND abs(date_diff('day', r.date, x.date)) <= 10) AS near,
      (SELECT min(r.k) FROM er r WHERE r.symbol = x.symbol AND NOT list_contains(m.used, r.k) AND r.date = x.date) AS same
    FROM mt m JOIN eo x ON x.symbol = m.symbol AND x.k = m.k + 1) t),
ended AS MATERIALIZED (SELECT symbol, arg_max(used, k) AS used, arg_max(said, k) AS said FROM mt GROUP BY symbol),
rest AS (SELECT r.symbol, list(concat('ONLY_REFERENCE ', r.date, ' x', printf('%.4f', exp(r.step))) ORDER BY r.k) AS said FROM er r JOIN ended e ON e.symbol = r.symbol WHERE NOT list_contains(e.used, r.k) GROUP BY r.symbol),
st AS (SELECT symbol, count(*) AS n, median(abs(d)) AS med, max(abs(d)) AS mx, avg(d) AS mean, stddev_pop(d) AS sd, count(*) FILTER (abs(sa) > {LN101}) AS na, count(*) FILTER (abs(sb) > {LN101}) AS nb FROM lv GROUP BY symbol),
names AS (SELECT symbol, max(o) AS o, max(r) AS r FROM (SELECT symbol, 1 AS o, 0 AS r FROM fx_ours UNION ALL SELECT symbol, 0, 1 FROM fx_reference) GROUP BY symbol),
z0 AS (SELECT n.symbol, o + r < 2 AS one_side, coalesce(st.n, 0) AS n, med, mx, mean, sd, na, nb, list_concat(coalesce(e.said, []), coalesce(rest.said, [])) AS said, CASE WHEN n.symbol = 'S9' THEN 'reference does not track spin-offs' END AS why
  FROM names n LEFT JOIN st USING (symbol) LEFT JOIN ended e USING (symbol) LEFT JOIN rest USING (symbol)),
z AS MATERIALIZED (SELECT *, array_to_string(said, '; ') AS texts, CASE WHEN one_side OR n < 5 THEN 'NOT_COMPARABLE' WHEN len(said) = 0 AND mx <= {LN1001} THEN 'EXACT' WHEN len(said) = 0 AND mx <= {LN102} THEN 'MINOR'
  WHEN len(said) = 0 AND sd <= {LN1001} THEN 'EXACT_ADJUSTED_EQUIV' WHEN why IS NOT NULL THEN 'EXPLAINED' WHEN len(said) > 0 AND len(list_filter(said, lambda x: NOT starts_with(x, 'DATE_DIFFERS'))) = 0 THEN 'DATE_DIFFERS' ELSE 'MISMATCH' END AS c FROM z0)"""

REPORT = """SELECT symbol, c AS classification, CASE WHEN one_side THEN 'one or both sides have no data' WHEN n < 5 THEN printf('%d common date(s), at least 5 needed', n) WHEN c = 'EXACT' THEN 'all events and all dates agree exactly'
  WHEN c = 'MINOR' THEN 'all events agree, levels within the minor tolerance' WHEN c = 'EXACT_ADJUSTED_EQUIV' THEN 'all events agree, levels differ by a constant' WHEN c = 'EXPLAINED' THEN why WHEN len(said) > 0 THEN texts
  ELSE printf('no event differs, but levels do by up to %.4f and not in parallel', mx) END AS detail, CAST(n AS BIGINT) AS n_dates_compared,
  CASE WHEN c <> 'NOT_COMPARABLE' THEN round(med, 9) END AS median_abs_ln_diff, CASE WHEN c <> 'NOT_COMPARABLE' THEN round(mx, 9) END AS max_abs_ln_diff, CASE WHEN c <> 'NOT_COMPARABLE' THEN round(mean, 9) END AS mean_ln_diff,
  CASE WHEN c <> 'NOT_COMPARABLE' THEN round(sd, 6) END AS std_ln_diff, CAST(CASE WHEN c <> 'NOT_COMPARABLE' THEN na ELSE 0 END AS BIGINT) AS n_events_ours, CAST(CASE WHEN c <> 'NOT_COMPARABLE' THEN nb ELSE 0 END AS BIGINT) AS n_events_reference,
  CASE WHEN c = 'NOT_COMPARABLE' THEN '' ELSE texts END AS event_issues FROM z"""

GATE = """SELECT count(*) AS n_total, count(*) FILTER (c <> 'NOT_COMPARABLE') AS n_comparable, count(*) FILTER (c = 'NOT_COMPARABLE') AS n_not_comparable, count(*) FILTER (c IN ('EXACT', 'MINOR', 'EXACT_ADJUSTED_EQUIV', 'EXPLAINED')) AS n_passing,
  count(*) FILTER (c = 'MISMATCH') AS n_mismatch, CAST(count(*) FILTER (c IN ('EXACT', 'MINOR', 'EXACT_ADJUSTED_EQUIV', 'EXPLAINED')) AS DOUBLE) / count(*) FILTER (c <> 'NOT_COMPARABLE') AS pass_rate,
  CAST(0.99 AS DOUBLE) AS min_pass_rate, CAST(count(*) FILTER (c IN ('EXACT', 'MINOR', 'EXACT_ADJUSTED_EQUIV', 'EXPLAINED')) AS DOUBLE) / count(*) FILTER (c <> 'NOT_COMPARABLE') >= 0.99 AS gate_passed FROM z"""


def audit_of_chain() -> str:
    """What each of the chain's stages s0 to s6 told, from the difference of its input and its output."""
    row = lambda stage, decision, detail, src, where: f"SELECT '{stage}' AS stage, CAST(a.rid AS BIGINT) AS rid, a.symbol, a.date, a.ratio_from, a.ratio_to, '{decision}' AS decision, {detail} AS detail FROM {src} WHERE {where}"
    none = "CAST(NULL AS VARCHAR)"
    collapsed = [row(name, "collapsed", none, f"s{i - 1} a", f"a.rid NOT IN (SELECT rid FROM s{i})") for i, name in ((2, "duplicate"), (3, "same_date"), (4, "near_date"))]
    large = f"abs(ln(a.ratio_from / a.ratio_to)) >= {LN2}"
    return "\nUNION ALL ".join([
        row("post_coverage", "dropped", "CAST(l.last_bar AS VARCHAR)", "fx_claims a JOIN (SELECT symbol, max(date) AS last_bar FROM fx_bars GROUP BY symbol) l USING (symbol)", "a.date > l.last_bar"),
        row("composite", "composed", none, "s0 a", "a.rid IN (SELECT unnest(rids) FROM s1_c)"),
        row("composite", "left_as_conflict", none, "s0 a", "a.rid IN (SELECT unnest(rids) FROM s1_all) AND a.rid NOT IN (SELECT unnest(rids) FROM s1_c)"),
        *collapsed,
        row("snap", "moved", "CAST(b.date AS VARCHAR)", "s4 a JOIN s5 b USING (rid)", "a.date <> b.date"),
        row("phantom", "refuted", "CAST(round(g.gap, 4) AS VARCHAR)", "s5 a JOIN s6_gap g USING (rid)", "a.rid NOT IN (SELECT rid FROM s6)"),
        row("phantom", "unmeasurable_kept", none, "s5 a JOIN s6_gap g USING (rid)", f"g.gap IS NULL AND {large}"),
    ])


#: Groups of different ratios of one source and day, whatever their directions.
ALL_LEGS = """s1_all AS (SELECT list(rid) AS rids FROM s0 WHERE source IS NOT NULL AND ratio_from <> ratio_to GROUP BY symbol, date, source
  HAVING count(*) > 1 AND count(DISTINCT (round(ratio_from, 12), round(ratio_to, 12))) > 1)"""


def chain(*stages) -> tuple[list[str], str]:
    ctes, at = [], "fx_claims"
    for i, st in enumerate(stages):
        ctes.append(st(at, f"s{i}"))
        at = f"s{i}"
    return ctes, at


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["apply_adjustment_daily"] = _q(_TAPE, [EVENTS], "SELECT b.symbol, b.date, round(coalesce(product(e.m), 1.0), 9) AS price_factor, round(any_value(b.close) * coalesce(product(e.m), 1.0), 6) AS adj_close, round(any_value(b.volume) / coalesce(product(e.m), 1.0), 4) AS adj_volume FROM fx_bars b LEFT JOIN ev e ON e.symbol = b.symbol AND e.date > b.date GROUP BY b.symbol, b.date")
    sql["apply_adjustment_ticks_tz"] = _q(("fx_ticks", "fx_tick_claims"), [], f"SELECT t.symbol, t.event_id, round(CASE WHEN {TOKYO.format(z='Asia/Tokyo')} < c.date THEN t.price * 0.25 ELSE t.price END, 6) AS adj_close, CAST({TOKYO.format(z='Asia/Tokyo')} < c.date AS INTEGER) AS before_split FROM fx_ticks t JOIN fx_tick_claims c USING (symbol)")
    sql["factor_table"] = _q(_TAPE, [EVENTS, "st AS (SELECT symbol, date FROM ev UNION ALL SELECT symbol, DATE '1990-01-01' FROM ev GROUP BY symbol HAVING DATE '1990-01-01' < min(date))"], "SELECT s.symbol, s.date, round(coalesce(product(e.m), 1.0), 9) AS price_factor, round(1.0 / coalesce(product(e.m), 1.0), 9) AS volume_factor FROM st s LEFT JOIN ev e ON e.symbol = s.symbol AND e.date > s.date GROUP BY s.symbol, s.date")
    sql["gap_measure"] = _q(_TAPE, [own_gap("fx_claims", "g")], "SELECT CAST(rid AS BIGINT) AS rid, round(gap, 9) AS gap FROM g")
    for name, stages in {
        "drop_post_coverage": [post_coverage], "compose_legs": [composite], "collapse_duplicates": [duplicates], "collapse_same_date": [same_date],
        "collapse_near_date": [near_date], "snap_to_tape": [snap], "refute_phantoms": [phantoms],
        "collapse_all": [post_coverage, composite, duplicates, same_date, near_date, snap, phantoms],
    }.items():
        ctes, last = chain(*stages)
        sql[name] = _q(_TAPE, ctes, f"{_OUT} {last}")
    ctes, _ = chain(post_coverage, composite, duplicates, same_date, near_date, snap, phantoms)
    audit = audit_of_chain()
    sql["collapse_audit"] = _q(_TAPE, [*ctes, ALL_LEGS], audit)
    sql["collapse_totals"] = _q(_TAPE, [*ctes, ALL_LEGS, f"au AS ({audit})"], "SELECT stage, decision, count(*) AS n FROM au GROUP BY stage, decision")
    ctes, last = chain(composite, duplicates, same_date, near_date)
    untold = [c.replace("FROM fx_bars x", "FROM no_bars x") for c in ctes]
    sql["collapse_without_tape"] = _q(_TAPE, ["no_bars AS (SELECT * FROM fx_bars WHERE false)", *untold], f"{_OUT} {last}")
    sql["scan_jumps"] = _q(("fx_bars", "fx_claims"), [JUMPS, EXPLAINED], "SELECT x.symbol, x.date, x.prev_date, round(exp(x.shift), 6) AS measured_ratio, CASE WHEN isinf(x.z) THEN NULL ELSE round(x.z, 4) END AS z_score, coalesce(x.one_day_end, y.date) AS reverted_on FROM walk w JOIN c0 x ON x.symbol = w.symbol AND x.i = w.i LEFT JOIN c0 y ON y.symbol = w.symbol AND y.i = w.mate WHERE w.shown")
    sql["reconcile"] = _q(("fx_ours", "fx_reference"), [ALIGNED, STEPS], REPORT)
    sql["reconcile_gate"] = _q(("fx_ours", "fx_reference"), [ALIGNED, STEPS], GATE)
    sql["drop_mislabels"] = _q(_TAPE, [], f"{_OUT} fx_claims WHERE rid % 10 <> 5")
    sql["unique_boundary"] = _q(_TAPE, [boundaries("fx_claims", "b")], "SELECT CAST(rid AS BIGINT) AS rid, tape_date, round(r, 6) AS measured_1d FROM b")
    sql["bad_print_guard_no_truth"] = _q(("fx_bars",), [_guard("fx_bars", None, 300)], "SELECT * FROM g")
    sql["bad_print_guard"] = _q(("fx_tick_bars", "fx_truth"), [_guard("fx_tick_bars", "fx_truth", 2)], "SELECT * FROM g")
    sql["truth_from_ticks"] = _q(("fx_truth",), [], "SELECT symbol, date, round(truth_high, 6) AS truth_high, round(truth_low, 6) AS truth_low, CAST(truth_n AS BIGINT) AS truth_n FROM fx_truth")
    sql["jump_candidates"] = _q(("fx_bars",), [JUMPS], "SELECT symbol, date, prev_date, round(shift, 6) AS shift, CASE WHEN isinf(z) THEN NULL ELSE round(z, 4) END AS z, one_day_end FROM cand")
    sql["classify_jumps"] = _q(("fx_bars",), [JUMPS, move("cand", "mv", "prev_date", "date")], f"SELECT symbol, date, round(wa / wb, 6) AS witness_ratio, CASE WHEN wa IS NULL OR wb IS NULL THEN 'UNEXPLAINED' WHEN abs(ln(wa / wb) - shift) <= {LN135} THEN 'REAL_MOVE' WHEN abs(ln(wa / wb) - shift) > greatest({LN16}, 0.5 * abs(shift)) THEN 'PROVIDER_BREAK' ELSE 'UNEXPLAINED' END AS classification FROM mv")
    sql["witness_move"] = _q(("fx_bars",), [JUMPS, move("cand", "mv", "prev_date", "date")], "SELECT symbol, date, round(ln(wa / wb), 9) AS witness_ln FROM mv")
    pv = "pv AS MATERIALIZED (SELECT c.*, (SELECT max(w.date) FROM fx_witness w WHERE w.symbol = c.symbol AND w.date < c.date) AS prev FROM fx_claims c)"
    off = "abs(ln(wa / wb) - ln(ratio_from / ratio_to))"
    sql["claims_vs_witness"] = _q(_TAPE, [pv, move("pv", "mv", "prev", "date")], f"SELECT CAST(rid AS BIGINT) AS rid, CASE WHEN wa IS NULL OR wb IS NULL THEN 'unavailable' WHEN {off} <= {LN135} THEN 'confirmed' WHEN abs(ln(ratio_from / ratio_to)) >= {LN15} AND {off} > greatest({LN16}, 0.5 * abs(ln(ratio_from / ratio_to))) THEN 'contradicted' ELSE 'unclear' END AS verdict, round(wa / wb, 6) AS witness_ratio FROM mv")
    runs = """c0 AS MATERIALIZED (SELECT symbol, date, close, lag(date) OVER w AS before, CASE WHEN close <> lag(close) OVER w THEN 1 ELSE 0 END AS ch, count(*) OVER (PARTITION BY symbol) AS cnt FROM fx_frozen WINDOW w AS (PARTITION BY symbol ORDER BY date)),
c1 AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM c0 WHERE cnt >= 3),
runs AS MATERIALIZED (SELECT symbol, run, min(date) AS start, max(date) AS "end", count(*) AS n_bars, any_value(close) AS close, arg_min(before, date) AS before FROM c1 GROUP BY symbol, run HAVING count(*) > 1),
own AS (SELECT symbol, count(*) AS runs, list_sort(list(n_bars))[CAST(least(count(*) - 1, floor(0.99 * count(*))) AS BIGINT) + 1] AS own FROM runs GROUP BY symbol),
stale AS MATERIALIZED (SELECT r.*, coalesce(before, start) AS b4 FROM runs r JOIN own USING (symbol) WHERE n_bars >= CASE WHEN runs >= 20 THEN greatest(own, 3) ELSE 3 END),
wit AS MATERIALIZED (SELECT s.*, (SELECT arg_max(c.close, c.date) FROM fx_calm c WHERE c.symbol = s.symbol AND c.date <= s.b4) AS wb, (SELECT arg_max(c.close, c.date) FROM fx_calm c WHERE c.symbol = s.symbol AND c.date <= s."end") AS we,
 (SELECT max(c.close) / min(c.close) FROM fx_calm c WHERE c.symbol = s.symbol AND c.date BETWEEN s.start AND s."end") AS span FROM stale s)"""
    sql["stale_runs"] = _q(("fx_frozen", "fx_calm"), [runs], "SELECT symbol, start, \"end\", CAST(n_bars AS BIGINT) AS n_bars, round(close, 6) AS close, round(ln(we / wb), 9) AS witness_move, CASE WHEN wb IS NULL OR we IS NULL THEN 'UNVERIFIED' WHEN abs(ln(we / wb)) > " + LN102 + " OR span > 1.02 THEN 'STALE_FEED' ELSE 'ILLIQUID' END AS classification FROM wit")
    shifts = """p0 AS (SELECT symbol, date, s.close AS p, c.close AS w FROM fx_shifted s JOIN fx_calm c USING (symbol, date)),
p1 AS MATERIALIZED (SELECT symbol, date, count(*) OVER (PARTITION BY symbol) AS cnt, ln(p / lag(p) OVER o) AS rp, ln(w / lag(w) OVER o) AS rw FROM p0 WINDOW o AS (PARTITION BY symbol ORDER BY date)),
p2 AS MATERIALIZED (SELECT *, lag(rw) OVER o AS r1, lead(rw) OVER o AS r2 FROM p1 WHERE cnt >= 22 WINDOW o AS (PARTITION BY symbol ORDER BY date)),
p3 AS MATERIALIZED (SELECT symbol, date, row_number() OVER o AS i, avg(abs(rp - rw)) OVER f AS e0, avg(abs(rp - r1)) OVER f AS ep, avg(abs(rp - r2)) OVER f AS em FROM p2 WHERE rp IS NOT NULL AND rw IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL
  WINDOW o AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
p4 AS MATERIALIZED (SELECT symbol, date, i - 20 AS k, e0, least(ep, em) AS best, CASE WHEN e0 > 0.004 AND least(ep, em) < 0.5 * e0 THEN CASE WHEN ep <= em THEN 1 ELSE -1 END ELSE 0 END AS sh FROM p3 WHERE i >= 20),
p5 AS (SELECT *, CASE WHEN sh <> lag(sh) OVER o THEN 1 ELSE 0 END AS turn FROM p4 WINDOW o AS (PARTITION BY symbol ORDER BY date)),
p6 AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS span FROM p5),
p7 AS (SELECT symbol, sh, min(k) AS k0, max(k) AS k1, max(date) AS e, max(e0) AS ae, min(best) AS se FROM p6 WHERE sh <> 0 GROUP BY symbol, span, sh)"""
    sql["date_shifts"] = _q(("fx_shifted", "fx_calm"), [shifts], "SELECT a.symbol, b.date AS start, a.e AS \"end\", CAST(k1 - k0 + 20 AS BIGINT) AS n_sessions, CAST(a.sh AS BIGINT) AS shift, round(ae, 6) AS aligned_error, round(se, 6) AS shifted_error, 'DATE_SHIFT' AS classification FROM p7 a JOIN p4 b ON b.symbol = a.symbol AND b.k = greatest(a.k0 - 19, 0)")
    sql["reconcile_levels"] = _q(("fx_ours", "fx_reference"), [ALIGNED], "SELECT symbol, count(*) AS n_dates_compared, round(median(abs(d)), 9) AS median_abs_ln_diff, round(max(abs(d)), 9) AS max_abs_ln_diff, round(avg(d), 9) AS mean_ln_diff, round(stddev_pop(d), 6) AS std_ln_diff, count(*) FILTER (ea) AS n_events_ours, count(*) FILTER (eb) AS n_events_reference FROM j2 GROUP BY symbol HAVING count(*) >= 5")
    own = "CASE WHEN h.security_id IS NULL THEN b.symbol ELSE h.security_id END"
    sql["rekey"] = _q(("fx_bars", "fx_history"), [], f"SELECT {own} AS symbol, b.date, round(b.close, 6) AS close, b.symbol AS ticker FROM fx_bars b LEFT JOIN fx_history h ON h.symbol = b.symbol AND b.date >= h.valid_from AND (h.valid_to IS NULL OR b.date <= h.valid_to)")
    sql["security_bars"] = _q(("fx_bars", "fx_history"), [], "SELECT h.security_id AS symbol, b.date, round(b.close, 6) AS close FROM fx_bars b JOIN fx_history h ON h.symbol = b.symbol AND b.date >= h.valid_from AND (h.valid_to IS NULL OR b.date <= h.valid_to) UNION ALL SELECT symbol, date, round(close, 6) FROM fx_bars WHERE symbol NOT IN (SELECT symbol FROM fx_history)")
    sql["history_overlaps"] = _q(("fx_overlaps",), [], "SELECT security_id, symbol, valid_from, valid_to, 'overlap' AS problem FROM (SELECT *, lag(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY symbol ORDER BY valid_from) AS p FROM fx_overlaps) WHERE p >= valid_from")
    sql["last_bar"] = _q(("fx_bars",), [], "SELECT symbol, max(date) AS last_bar FROM fx_bars GROUP BY symbol")
    sql["symbols"] = _q(("fx_bars",), [], "SELECT DISTINCT symbol FROM fx_bars")
    return sql
