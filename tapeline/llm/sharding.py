"""Sharding by balanced label propagation.

Law ``rows``: the shards' row counts are at most one apart. Documents with equal texts are linked. Equal documents are
interchangeable, so the graph is kept as cells (text, shard, rows); a text in more than one shard has cut edges.

The first labels put whole texts where they fit, large ones first, each size class spread so that the shards' loads stay
level; what fits nowhere is split over the room that is left. A text with more rows than a shard fills one shard after
the other. Then rounds of joins move cells towards their neighbours: a cell wishes to go to the shard that holds most of
its text. Wishes are granted in order of their gain, and in two ways. Together, if the flows into and out of a shard
leave it within its quota, so full shards exchange cells with each other; and one by one, if a whole text of the right
size can go the other way, which cuts nothing. Both are decided from histograms of bounded size. Rows without links
take the room that is left, which makes the sizes exact.

Edge cases: null text has no bytes, checksum 0 and no links (empty texts are linked with each other); repeated rows, null
ids and ids of any type are placed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeline.llm.common import discard, few, materialize, with_index

SHARDS = 24
ROUNDS = 12
PIECE = 4096  # rows of one text that are placed by one key
PARTS = 16  # by a hash, of the wishes of one class
SWAPPED = 256  # rows of a cell up to which a whole text is sought for the way back


Deal = tuple[dict[int, list[int]], list[tuple[int, int, int, int]]]


def deal(sizes: list[tuple[int, int]], quota: list[int]) -> Deal:
    """Whole texts by size class, largest first: size -> places that each shard takes; and what has to be split.

    ``sizes``: (size, texts), each size once, so no more than the square root of twice the rows. A class's texts have
    ranks from 0; shard s takes the next ``places[s]`` ranks. Splits are (size, rank, shard, rows). Of two ways, loads
    kept level and shards filled up one after the other, the one that splits fewer texts.
    """
    return min((_deal(sizes, quota, level) for level in (True, False)), key=lambda d: len({(z, r) for z, r, _, _ in d[1]}))


def _deal(sizes: list[tuple[int, int]], quota: list[int], even: bool) -> Deal:
    room = np.array(quota, np.int64)
    places: dict[int, list[int]] = {}
    splits: list[tuple[int, int, int, int]] = []
    for size, m in sorted(sizes, reverse=True):
        fit = room // size
        whole = min(m, int(fit.sum()))
        if not even:
            before = np.cumsum(fit) - fit
            take = np.clip(whole - before, 0, fit)
            room = room - take * size
            places[size] = take.tolist()
            splits += _leftovers(room, size, whole, m)
            continue
        # the shards with most room take texts until theirs is level with the others': a search for the level
        lo, hi = 0, int(room.max())
        while lo < hi:
            level = (lo + hi) // 2
            if int(np.minimum(fit, np.maximum(0, -((level - room) // size))).sum()) <= whole:
                hi = level
            else:
                lo = level + 1
        take = np.minimum(fit, np.maximum(0, -((lo - room) // size)))
        left = whole - int(take.sum())
        for s in np.argsort(-(room - take * size), kind="stable"):
            if left and take[s] < fit[s]:
                take[s], left = take[s] + 1, left - 1
        for s in range(len(room)):  # rounding may still leave some
            more = min(left, int(fit[s] - take[s]))
            take[s], left = take[s] + more, left - more
        room = room - take * size
        places[size] = take.tolist()
        splits += _leftovers(room, size, whole, m)
    return places, splits


def _leftovers(room: np.ndarray, size: int, whole: int, m: int) -> list[tuple[int, int, int, int]]:
    """Texts that fit nowhere, over the largest rooms (which shrink)."""
    out = []
    for rank in range(whole, m):
        rows = size
        while rows:
            s = int(room.argmax())
            n = min(rows, int(room[s]))
            out.append((size, rank, s, n))
            room[s] -= n
            rows -= n
    return out


def _pick(values: list[int], at: Column) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])[at.cast("int")]


def _loads(cells: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _flows(asked: list, loads: list[int], quota: list[int]) -> list[int]:
    """Wishes (by place in ``asked``, best first) that can all be granted at once.

    The wished flows between shards, less the fewest rows that bring every shard to its quota: what is over in a shard is
    sent back along shortest paths of wishes to shards with room. Wishes are granted up to these flows. As cells don't add
    up to them exactly, some more are taken back, and those that fit after all are granted again.
    """
    n = len(quota)
    wish = np.zeros((n, n), np.int64)
    for w in asked:
        wish[w["shard"], w["to"]] += w["n"]
    over = np.array(loads) + wish.sum(0) - wish.sum(1) - np.array(quota)
    spare = wish.copy()
    while (over > 0).any():
        start = int(over.argmax())
        came, queue = {start: start}, [start]
        for t in queue:
            if over[t] < 0:
                break
            for s in range(n):
                if s not in came and (spare[s, t] > 0 or wish[t, s] > spare[t, s]):  # a wish s -> t to refuse, or t -> s to allow again
                    came[s] = t
                    queue.append(s)
        else:
            break
        path = [t]
        while path[-1] != start:
            path.append(came[path[-1]])
        steps = [(path[k], path[k + 1]) for k in range(len(path) - 1)]  # (s, t) from the end
        size = min([int(over[start]), int(-over[t]), *(int(spare[s, u]) if spare[s, u] > 0 else int(wish[u, s] - spare[u, s]) for s, u in steps)])
        for s, u in steps:
            if spare[s, u] > 0:
                spare[s, u] -= size
            else:
                spare[u, s] += size
        over[start] -= size
        over[t] += size
    now = list(loads)
    granted: set[int] = set()

    def grant(i: int, sign: int = 1) -> None:
        now[asked[i]["shard"]] -= sign * asked[i]["n"]
        now[asked[i]["to"]] += sign * asked[i]["n"]
        (granted.add if sign > 0 else granted.discard)(i)

    for i, w in enumerate(asked):
        if w["n"] <= spare[w["shard"], w["to"]]:
            spare[w["shard"], w["to"]] -= w["n"]
            grant(i)
    while full := [s for s in range(n) if now[s] > quota[s]]:
        into = [i for i in granted if asked[i]["to"] == full[0]]
        # of those that bring the shard to its quota the smallest, else the largest; from the shard with most room
        excess = now[full[0]] - quota[full[0]]
        grant(min(into, key=lambda i: (asked[i]["n"] < excess, abs(asked[i]["n"] - excess), now[asked[i]["shard"]] - quota[asked[i]["shard"]])), -1)
    for i in range(len(asked)):
        if i not in granted and now[asked[i]["to"]] + asked[i]["n"] <= quota[asked[i]["to"]]:
            grant(i)
    return sorted(granted)


def _swaps(asked: list, whole: dict[tuple[int, int], int], room: list[int]) -> tuple[list[tuple[int, int, int, int]], dict[tuple[int, int, int], int]]:
    """For cells of n rows that go s -> t, whole texts of about n rows that go t -> s.

    Returns the moves (s, t, n, cells) and, by (t, s, size), how many whole texts go back.
    """
    moves, back = [], defaultdict(int)
    for w in asked:
        s, t, n = w["shard"], w["to"], w["n"] // w["cells"]
        for _ in range(w["cells"]):
            sizes = sorted((z for z in range(max(1, n - room[t]), n + room[s] + 1) if whole.get((t, z), 0) > 0), key=lambda z: abs(z - n))
            if not sizes:
                break
            z = sizes[0]
            whole[(t, z)] -= 1
            room[s], room[t] = room[s] + n - z, room[t] + z - n
            back[(t, s, z)] += 1
            moves.append((s, t, n, 1))
    return moves, back


def propagate(cells: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """cells: (text, shard, n), within the quotas. Moves rows between the shards of a text until no wish can be granted."""
    spark, shards = cells.sparkSession, len(quota)
    for turn in range(rounds):
        loads = _loads(cells, shards)
        sums = cells.groupBy("text").agg(F.count("*").alias("cells"), F.sum("n").alias("all"), F.max_by("shard", F.struct("n", F.xxhash64("text", "shard"))).alias("to"))
        split = materialize(cells.join(sums.filter("cells > 1"), "text").filter("shard != to").join(cells.select("text", F.col("shard").alias("to"), F.col("n").alias("near")), ["text", "to"]))
        # cells of few rows are classes of their own, larger ones share eighths of an octave
        level = F.when(F.col("n") <= SWAPPED, F.col("n")).otherwise(SWAPPED + F.floor(8 * F.log2(F.col("n"))))
        wishes = split.select("text", "shard", "to", "n", "near", level.cast("int").alias("level"), F.pmod(F.xxhash64("text", "shard", F.lit(turn)), F.lit(PARTS)).cast("int").alias("part"))
        asked = wishes.groupBy("shard", "to", "level", "part").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum(F.col("n") * F.col("near")).alias("gain")).collect()
        asked = sorted(asked, key=lambda w: (-w["gain"] / w["n"], w["shard"], w["to"], w["part"]))
        if not asked:
            break
        together = _flows(asked, loads, quota)
        if together:
            key = spark.createDataFrame([(asked[i]["shard"], asked[i]["to"], asked[i]["level"], asked[i]["part"]) for i in together], "shard int, to int, level int, part int")
            moves = wishes.join(F.broadcast(key), ["shard", "to", "level", "part"], "left_semi").select("text", "shard", "to", "n")
        else:
            # whole texts of each size in each shard, and which of them go back
            whole = cells.join(sums.filter("cells = 1").select("text"), "text", "left_semi").filter(F.col("n") <= 2 * SWAPPED)
            held = {(r["shard"], r["n"]): r["k"] for r in whole.groupBy("shard", "n").agg(F.count("*").alias("k")).collect()}
            room = [q - used for q, used in zip(quota, loads, strict=True)]
            go, back = _swaps([w for w in asked if w["level"] <= SWAPPED], held, room)
            if not go:
                break
            total: dict[tuple[int, int, int], int] = defaultdict(int)
            for s, t, n, k in go:
                total[(s, t, n)] += k
            first = _some(wishes, total, "shard", "to", "n")
            # each way back takes the next texts of its class
            starts: dict[tuple[int, int], int] = defaultdict(int)
            ranges = []
            for (t, s, z), k in sorted(back.items()):
                ranges.append((t, z, starts[(t, z)], starts[(t, z)] + k, s))
                starts[(t, z)] += k
            limits = spark.createDataFrame(ranges, "shard int, n long, lo long, hi long, to int")
            ranked = _ranked(whole, dict(starts))
            second = ranked.join(F.broadcast(limits), ["shard", "n"]).filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("text", "shard", "to", "n")
            moves = first.unionByName(second)
        moves = materialize(moves)
        changed = cells.unionByName(moves.select("text", F.col("to").alias("shard"), "n")).unionByName(moves.select("text", "shard", (-F.col("n")).alias("n")))
        cells = materialize(changed.groupBy("text", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        discard(split, moves)
    return cells


def _some(rows: DataFrame, counts: dict[tuple, int], *by: str) -> DataFrame:
    """So many rows of each class, first by a hash. No task ranks more of a class than go."""
    kinds = dict(rows.dtypes)
    table = rows.sparkSession.createDataFrame([(*k, n) for k, n in counts.items()], ", ".join([*(f"{c} {kinds[c]}" for c in by), "_take long"]))
    own = Window.partitionBy(*by).orderBy(F.xxhash64("text"), "text")
    return rows.join(F.broadcast(table), list(by)).withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= max(counts.values())).filter(F.col("_r") <= F.col("_take")).select("text", "shard", "to", "n")


def _ranked(whole: DataFrame, most: dict[tuple[int, int], int]) -> DataFrame:
    """The first texts of each (shard, size), ranked by a hash; no more of a class than go back are ranked at last."""
    top = max(most.values())
    own = Window.partitionBy("shard", "n").orderBy(F.xxhash64("text"), "text")
    keys = whole.sparkSession.createDataFrame(list(most), "shard int, n long")
    return whole.join(F.broadcast(keys), ["shard", "n"], "left_semi").withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= top).withColumn("rank", F.col("_r") - 1).drop("_r")


def first_labels(groups: DataFrame, quota: list[int]) -> DataFrame:
    """cells of whole texts where they fit. groups: (text, n, idx): idx is the place by size, largest first."""
    spark, shards = groups.sparkSession, len(quota)
    sizes = sorted(((r["n"], r["k"]) for r in groups.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    places, splits = deal(sizes, quota)
    rows, start = [], 0
    for n, k in sizes:
        ends, end = [], 0
        for p in places[n]:
            end += p
            ends.append(end)
        rows.append((n, start, ends))
        start += k
    table = spark.createDataFrame(rows or [(0, 0, [0] * shards)], "n long, start long, ends array<long>")
    ranked = groups.join(F.broadcast(table) if few(table, 100_000) else table, "n").withColumn("rank", F.col("idx") - F.col("start"))
    whole = ranked.filter(F.col("rank") < F.col("ends")[shards - 1])
    whole = whole.select("text", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int").alias("shard"), "n")
    pieces = spark.createDataFrame(splits or [(0, 0, 0, 0)], "size long, rank long, shard int, part long")
    cut = ranked.join(pieces, (F.col("n") == F.col("size")) & (ranked["rank"] == pieces["rank"])).select("text", "shard", F.col("part").alias("n"))
    return whole.unionByName(cut)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("text"),
    )
    rows = materialize(rows)
    counts = rows.filter(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("n")).filter("n > 1")
    counts = materialize(with_index(counts, F.desc("n"), F.col("text"), name="idx"))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    cells = propagate(materialize(first_labels(counts, quota)), quota, rounds)
    linked = materialize(with_index(rows.join(counts.select("text"), "text", "left_semi"), F.col("text"), F.col("doc_id"), name="place"))
    single = with_index(rows.join(counts.select("text"), "text", "left_anti").drop("text"), F.col("doc_id"), F.col("text_crc32"), name="nth")
    firsts = linked.groupBy("text").agg(F.min("place").alias("first"))
    # a text's rows are dealt to its cells by their place; pieces of PIECE rows keep a hot text from being one key
    by_text = Window.partitionBy("text").orderBy("shard")  # a text has at most one cell for each shard
    upto = F.sum("n").over(by_text)
    ranges = cells.withColumns({"lo": upto - F.col("n"), "hi": upto})
    pieces = ranges.withColumn("piece", F.explode(F.sequence(F.floor(F.col("lo") / PIECE), F.floor((F.col("hi") - 1) / PIECE))))
    linked = linked.join(firsts, "text").withColumn("rank", F.col("place") - F.col("first")).withColumn("piece", F.floor(F.col("rank") / PIECE))
    cut = pieces.select("text", "piece", "shard", "lo", "hi")
    placed = linked.join(cut, ["text", "piece"]).filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select("doc_id", "size", "text_crc32", "shard")
    # rows without links fill the shards up in order of their place
    loads = _loads(cells, shards)
    ends, end = [], 0
    for q, used in zip(quota, loads, strict=True):
        end += q - used
        ends.append(end)
    target = F.lit(shards - 1)
    for s in range(shards - 1, -1, -1):
        target = F.when(F.col("nth") < ends[s], F.lit(s)).otherwise(target)
    single = single.select("doc_id", "size", "text_crc32", target.cast("int").alias("shard"))
    both = placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")).unionByName(single)
    done = with_index(both, F.col("shard"), F.col("doc_id"), F.col("text_crc32"), name="nth")
    begins = [sum(quota[:s]) for s in range(shards)]
    return done.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("nth") - _pick(begins, F.col("shard"))).alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
