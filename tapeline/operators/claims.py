"""Clean claims: eight stages that reduce raw split claims to the events that the tape supports.

Each stage takes normalised claims (``schemas.normalise_claims``: with ``rid``) and returns ``Stage(kept, audit)``: the
claims that go on, and a row for each decision; both are read from one table that the stage writes. ``bars`` are those of
``tape.bars_with_neighbours`` wherever a gap is measured; without them a stage falls back on its rules alone. Claims are
few beside the tape, so whatever is grouped here is bounded by one symbol's claims.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.scratch import few, materialize
from tapeline.functions.tape import bars_with_neighbours, implied_ln, local_tape, unique_boundaries, with_gap, with_own_gap
from tapeline.schemas import last_bar_dates, normalise_claims
from tapeline.settings import ChainSettings


FEW_CLAIMS = 50_000


class Stage(NamedTuple):
    kept: DataFrame
    audit: DataFrame


def _stage(claims: DataFrame, name: str, rows: DataFrame) -> Stage:
    """``rows``: claims with ``_keep``, and ``_decision`` (null where there is nothing to tell) and ``_detail``."""
    done = materialize(rows.select(*claims.columns, "_keep", "_decision", F.col("_detail").cast("string").alias("_detail")))
    told = done.filter("_decision is not null")
    audit = told.select(F.lit(name).alias("stage"), "rid", "symbol", "date", "ratio_from", "ratio_to", F.col("_decision").alias("decision"), F.col("_detail").alias("detail"))
    return Stage(done.filter("_keep").select(*claims.columns), audit)


def _drop(rows: DataFrame, gone: Column, decision: str, detail: Column | None = None) -> DataFrame:
    """Marks the rows that go, with the reason."""
    reason = F.lit(None) if detail is None else detail
    return rows.withColumns({"_keep": ~gone, "_decision": F.when(gone, decision), "_detail": F.when(gone, reason.cast("string"))})


def _split(claims: DataFrame, rows: DataFrame, old: dict[str, Column], also: Column, new: dict[str, Column]) -> DataFrame:
    """Each row with the values of ``old``, and, where ``also`` holds, once more with those of ``new``."""
    kinds = dict(claims.dtypes) | {"_keep": "boolean", "_decision": "string", "_detail": "string"}
    one = lambda values: F.struct(*[(values[c] if c in values else F.col(c) if c in claims.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    return rows.select(F.explode(F.when(also, F.array(one(old), one(new))).otherwise(F.array(one(old)))).alias("v")).select("v.*")


def _ratio_key(c: str) -> Column:
    return F.round(F.col(c), 12)


def source_rank(s: ChainSettings) -> Column:
    """Place of the source in the priorities; unknown and null sources come last."""
    rank = F.lit(len(s.source_priority))
    for i, name in reversed(list(enumerate(s.source_priority))):
        rank = F.when(F.col("source") == name, F.lit(i)).otherwise(rank)
    return rank


def drop_recorded_mislabels(claims: DataFrame, mislabels: DataFrame) -> Stage:
    """Claims that a citation names as another kind of event go, whatever the tape says."""
    cited = mislabels.select("symbol", F.col("date").cast("date").alias("date"), _ratio_key("ratio_from").alias("_f"), _ratio_key("ratio_to").alias("_t"), F.coalesce("citation", F.lit("")).alias("citation")).dropDuplicates(["symbol", "date", "_f", "_t"])
    keyed = claims.withColumns({"_f": _ratio_key("ratio_from"), "_t": _ratio_key("ratio_to")})
    seen = keyed.join(cited, ["symbol", "date", "_f", "_t"], "left")
    return _stage(claims, "mislabel", _drop(seen.withColumn("_hit", F.col("citation").isNotNull()), F.col("_hit"), "dropped", F.col("citation")))


def drop_post_coverage(claims: DataFrame, bars: DataFrame) -> Stage:
    """Claims dated after their symbol's last bar go; symbols without bars keep theirs."""
    last = last_bar_dates(bars.join(F.broadcast(claims.select("symbol").distinct()), "symbol", "left_semi") if few(claims) else bars)
    dated = claims.join(last, "symbol", "left")
    late = F.coalesce(F.col("date") > F.col("last_bar"), F.lit(False))
    return _stage(claims, "post_coverage", _drop(dated, late, "dropped", F.col("last_bar")))


def compose_same_day_legs(claims: DataFrame, bars: DataFrame | None = None, s: ChainSettings = ChainSettings()) -> Stage:
    """A reverse and a forward leg of one source on one day become one event with the product of their ratios.

    Legs stay as they are, and the audit calls them a conflict, where all go one way, or where the gap is measurable and
    matches one of them and not the product.
    """
    if not s.compose_same_source_legs:
        return _stage(claims, "composite", _drop(claims, F.lit(False), ""))
    m = F.col("ratio_from") / F.col("ratio_to")
    key = ["symbol", "date", "source"]
    legs = claims.filter(F.col("source").isNotNull() & (F.col("ratio_from") != F.col("ratio_to")) & (F.col("ratio_from") > 0) & (F.col("ratio_to") > 0))
    # products multiply in the order of rid, so that results don't depend on the plan
    inner = Window.partitionBy(*key).orderBy("rid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    legs = legs.withColumns({"pf": F.product("ratio_from").over(inner), "pt": F.product("ratio_to").over(inner)})
    groups = legs.groupBy(*key).agg(
        F.min("rid").alias("rid"), F.first("pf").alias("pf"), F.first("pt").alias("pt"), F.count("*").alias("n"),
        F.count_distinct(_ratio_key("ratio_from"), _ratio_key("ratio_to")).alias("kinds"), F.bool_or(m > 1).alias("up"), F.bool_or(m < 1).alias("down"),
        F.collect_list(F.log(m)).alias("legs"), F.sort_array(F.collect_list("rid")).alias("rids"),
    ).filter((F.col("n") > 1) & (F.col("kinds") > 1))
    if bars is None:
        judged = groups.withColumn("gap", F.lit(None).cast("double"))
    else:
        judged = with_gap(groups.withColumns({"first": F.col("date"), "last": F.col("date")}), bars, s.max_gap_calendar_days)
    lm, tol = F.log("gap"), s.gap_pick_tolerance_ln
    one_leg = F.exists("legs", lambda x: F.abs(lm - x) <= tol)
    other = F.coalesce((F.abs(lm - F.log(F.col("pf") / F.col("pt"))) > tol) & one_leg, F.lit(False))
    conflict = ~(F.col("up") & F.col("down")) | other
    each = judged.select(F.explode("rids").alias("rid"), conflict.alias("_conflict"), F.col("rid").alias("_first"), "pf", "pt")
    seen = claims.join(each, "rid", "left")
    in_group, bad = F.col("_conflict").isNotNull(), F.coalesce("_conflict", F.lit(False))
    first = in_group & ~bad & (F.col("rid") == F.col("_first"))
    old = {"_keep": ~in_group | bad, "_decision": F.when(bad, "left_as_conflict").when(in_group, "composed")}
    new = {"ratio_from": F.col("pf"), "ratio_to": F.col("pt"), "type": F.lit("composite"), "_keep": F.lit(True), "_decision": F.lit(None)}
    return _stage(claims, "composite", _split(claims, seen, old, first, new))


def event_clusters(claims: DataFrame, bars: DataFrame | None, s: ChainSettings = ChainSettings()) -> DataFrame:
    """Claims with ``block`` and ``cluster``: which rows of one symbol and ratio tell of the same event.

    A block takes rows within the window of its first row. Two rows of a block that the tape confirms at dates further
    apart than the near window are events of their own; each row goes to the nearest such date, the earlier on ties.
    """
    gaps = claims.withColumn("gap", F.lit(None).cast("double")) if bars is None else with_own_gap(claims, bars, s.max_gap_calendar_days)
    ok = F.coalesce(F.abs(F.log("gap") - implied_ln()) <= s.gap_pick_tolerance_ln, F.lit(False))
    key = ["symbol", "ratio_from", "ratio_to"]
    listed = gaps.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("date", "rid", ok.alias("ok")))).alias("rows"))
    start = F.struct(F.lit(None).cast("date").alias("start"), F.lit(-1).alias("block"), F.array().cast("array<struct<rid:bigint,date:date,ok:boolean,block:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["start"].isNull() | (F.datediff(x["date"], acc["start"]) > s.collapse_window_days)
        block = F.when(new, acc["block"] + 1).otherwise(acc["block"])
        row = F.struct(x["rid"].cast("bigint").alias("rid"), x["date"].alias("date"), x["ok"].alias("ok"), block.alias("block"))
        return F.struct(F.when(new, x["date"]).otherwise(acc["start"]).alias("start"), block.alias("block"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = listed.select(*key, F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("r")).select(*key, "r.*")
    blocks = rows.groupBy(*key, "block").agg(F.sort_array(F.collect_list(F.struct("date", "rid", "ok"))).alias("rows"))

    def anchor(acc: Column, x: Column) -> Column:
        far = (F.size(acc) == 0) | (F.datediff(x["date"], F.try_element_at(acc, F.lit(-1))) > s.near_date_window_days)
        return F.when(x["ok"] & far, F.concat(acc, F.array(x["date"]))).otherwise(acc)

    blocks = blocks.withColumn("anchors", F.aggregate("rows", F.array().cast("array<date>"), anchor))
    each = blocks.select("block", "anchors", F.explode("rows").alias("r")).select("block", "anchors", "r.rid", "r.date")
    nearest = F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(F.datediff(F.col("date"), a)).alias("days"), i.alias("i"))))["i"]
    cluster = F.when(F.size("anchors") > 1, nearest).otherwise(0)
    return claims.join(each.select("rid", "block", cluster.alias("cluster")), "rid")


def collapse_duplicates(claims: DataFrame, bars: DataFrame | None = None, s: ChainSettings = ChainSettings()) -> Stage:
    """One row for each event that several rows of one ratio tell of: the best source's, then the latest."""
    best = Window.partitionBy("symbol", "ratio_from", "ratio_to", "block", "cluster").orderBy(source_rank(s), F.col("date").desc(), "rid")
    ranked = event_clusters(claims, bars, s).withColumn("_n", F.row_number().over(best))
    return _stage(claims, "duplicate", _drop(ranked, F.col("_n") > 1, "collapsed"))


def _one_per_group(claims: DataFrame, rows: DataFrame, group: list[str], order: list[Column], bars: DataFrame | None, s: ChainSettings, stage: str) -> Stage:
    """The first row of each group, or, where the tape can tell, the row whose ratio fits the measured gap best."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumns({"_n": F.row_number().over(w.orderBy(*order, F.col("rid"))), "_size": F.count("*").over(w)})
    if bars is None:
        picked = ranked.withColumn("_pick", F.col("_n") == 1)
    else:
        groups = ranked.filter("_size > 1").groupBy(*group).agg(F.min("rid").alias("rid"), F.min("date").alias("first"), F.max("date").alias("last"))
        told = with_gap(groups, bars, s.max_gap_calendar_days).filter("gap > 0").select(*group, "gap")
        err = F.abs(F.log("gap") - implied_ln())
        fit = ranked.join(told, group, "left").withColumn("_err", err)
        fit = fit.withColumn("_fit", F.row_number().over(w.orderBy(F.col("_err").asc_nulls_last(), "rid")))
        decided = F.coalesce(F.min("_err").over(w) <= s.gap_pick_tolerance_ln, F.lit(False))
        picked = fit.withColumn("_pick", F.when(decided, F.col("_fit") == 1).otherwise(F.col("_n") == 1))
    return _stage(claims, stage, _drop(picked, ~F.col("_pick"), "collapsed"))


def collapse_same_date(claims: DataFrame, bars: DataFrame | None = None, s: ChainSettings = ChainSettings()) -> Stage:
    noop = F.col("ratio_from") == F.col("ratio_to")
    size = F.abs(F.log(F.try_divide("ratio_to", "ratio_from"))).desc_nulls_last()
    return _one_per_group(claims, claims, ["symbol", "date"], [noop, source_rank(s), size], bars, s, "same_date")


def collapse_near_date(claims: DataFrame, bars: DataFrame | None = None, s: ChainSettings = ChainSettings()) -> Stage:
    """Claims of one symbol that follow each other within the near window are one event."""
    by = Window.partitionBy("symbol").orderBy("date", "rid")
    fresh = F.coalesce(F.datediff("date", F.lag("date").over(by)) > s.near_date_window_days, F.lit(True))
    islands = claims.withColumn("_new", fresh.cast("int")).withColumn("_island", F.sum("_new").over(by)).drop("_new")
    noop = F.col("ratio_from") == F.col("ratio_to")
    return _one_per_group(claims, islands, ["symbol", "_island"], [noop, source_rank(s), F.col("date").desc()], bars, s, "near_date")


def snap_to_tape(claims: DataFrame, bars: DataFrame, s: ChainSettings = ChainSettings()) -> Stage:
    """Moves large claims to the one day near their date that shows their jump. ``bars`` are plain bars, or a ``local_tape``."""
    large = claims.filter(F.abs(implied_ln()) >= s.large_ratio_threshold_ln)
    found = unique_boundaries(large, bars, s)
    joined = claims.join(found, "rid", "left")
    moved = F.col("tape_date").isNotNull() & (F.col("tape_date") != F.col("date"))
    old = {"_keep": ~moved, "_decision": F.when(moved, "moved"), "_detail": F.when(moved, F.col("tape_date").cast("string"))}
    new = {"date": F.col("tape_date"), "_keep": F.lit(True), "_decision": F.lit(None), "_detail": F.lit(None)}
    return _stage(claims, "snap", _split(claims, joined, old, moved, new))


def refute_phantoms(claims: DataFrame, bars: DataFrame, vintage: DataFrame | None = None, s: ChainSettings = ChainSettings()) -> Stage:
    """Large claims over a flat tape go; what cannot be measured, or came adjusted already, stays."""
    seen = with_own_gap(claims, bars, s.max_gap_calendar_days)
    if vintage is None:
        seen = seen.withColumn("_vintage", F.lit(None).cast("string"))
    else:
        v = vintage.select("symbol", F.col("date").cast("date").alias("date"), F.col("vintage").alias("_vintage")).dropDuplicates(["symbol", "date"])
        seen = seen.join(v, ["symbol", "date"], "left")
    implied, lm = implied_ln(), F.log("gap")
    asked = (F.abs(implied) >= s.large_ratio_threshold_ln) & ~F.coalesce(F.col("_vintage") == "ADJUSTED", F.lit(False))
    flat = (F.abs(lm) < s.phantom_flat_tolerance_ln) & (F.abs(lm - implied) > s.phantom_disagreement_tolerance_ln)
    gone = F.coalesce(asked & flat, F.lit(False))
    unseen = F.coalesce(asked, F.lit(False)) & F.col("gap").isNull()
    decision = F.when(gone, "refuted").when(unseen, "unmeasurable_kept")
    return _stage(claims, "phantom", seen.withColumns({"_keep": ~gone, "_decision": decision, "_detail": F.when(gone, F.round("gap", 4).cast("string"))}))


def collapse_all(claims: DataFrame, bars: DataFrame | None = None, mislabels: DataFrame | None = None, vintage: DataFrame | None = None, s: ChainSettings = ChainSettings()) -> Stage:
    """The whole chain, in the order that the rules ask for. Each stage writes its claims to the shared folder.

    Without ``bars`` the stages go by their rules alone, and those that only the tape can decide are left out.
    """
    now, audits = materialize(normalise_claims(claims)), []
    # few claims need no exchange among themselves: one partition serves all their groups and windows
    shape = (lambda df: df.coalesce(1)) if few(now, FEW_CLAIMS) else (lambda df: df)
    near = local = None
    if bars is not None:
        local = materialize(local_tape(now, bars))
        near = materialize(bars_with_neighbours(local))
    steps = [
        lambda c: drop_recorded_mislabels(c, mislabels) if mislabels is not None else None,
        lambda c: drop_post_coverage(c, bars) if bars is not None else None,
        lambda c: compose_same_day_legs(c, near, s),
        lambda c: collapse_duplicates(c, near, s),
        lambda c: collapse_same_date(c, near, s),
        lambda c: collapse_near_date(c, near, s),
        lambda c: snap_to_tape(c, local, s) if bars is not None else None,
        lambda c: refute_phantoms(c, near, vintage, s) if bars is not None else None,
    ]
    for step in steps:
        if (done := step(shape(now))) is not None:
            now = done.kept
            audits.append(done.audit)
    audit = audits[0]
    for a in audits[1:]:
        audit = audit.unionByName(a)
    return Stage(now, audit)


def stage_totals(audit: DataFrame) -> DataFrame:
    """(stage, decision, n): how often each stage decided what, composite conflicts included."""
    return audit.groupBy("stage", "decision").agg(F.count("*").alias("n"))
