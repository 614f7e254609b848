"""N-gram Jaccard self-join by a size-aware heavy-light join.

A document's set holds the hashes of its distinct word n-grams. Two sets link when den * |both| >= num * |either|. Equal
sets are one set from the start. All sets take their elements in one order, rare before frequent, so two sets that link
share k elements within their first ``size - need + k``, where need is the overlap that the threshold asks of the size.

Small sets enumerate all pairs (the fixed-size subsets) of that prefix for k = 2 and meet where a pair is equal; large
sets are found by scanning the inverted lists of their prefix elements for k = 1. The boundary is the size up to which
the subsets of a set cost less than its lists, given the mean length of lists in these data; sets so near below the
boundary that a larger one can link with them are in the lists as well.

Lists are not expanded into pairs. First each set is compared with the set that is smallest in most of its lists, which
joins groups of copies; afterwards only sets of one list that are still in different components are compared. So
every link is either verified or inside a component already, and the components are exact.

Large sets take a longer prefix, k = 1 + size // STEP, so those that link share at least the smaller k of the two. That
gives two exact savings. Lists of over LONG sets are left aside: a set with no more such lists than its partners' k - 1
must meet every partner in a short list too. And pairs that share fewer elements than they must are dropped before their
texts are fetched.

Sets with more long lists are near copies of something, or hold little but frequent passages. Each long list names its
most central set as head, and each of those sets is compared with the heads of its lists, which gives what it lacks (d
elements) and adds. Two sets near one head p share at most |p| - max(d) elements of it, so they can only link if that
is enough for their sizes, which classes of (size, d) decide, or if they add a common element, which a join on added
elements finds. Sets far from the head name another head among themselves, and so on for ``HEADS`` rounds; the Jaccard
distance is a metric, so a near and a far set link only if the near one is in the band that stays with the far ones. What
is far from all heads of a list is compared in pairs.

Frequent elements are found by counting in every partition and summing the counts; they only move to the end of the
order (at most ``MOST_FREQUENT`` of them are sent to the executors), which changes cost but no result. The keys of a
frequent element are dealt over a number of salts that grows with its count, so none has more than about ``SALT_ROWS``
rows; an element that no task met three times in two million is in less than one document of a thousand.

Edge cases: null or empty text has an empty set, linked with nothing; a text with fewer words than an n-gram has one
element, its whole sequence; repeated rows link as equal sets; a row with a null id links as others do but is no smallest
id, so a component of such rows only has a null id; ids other than whole numbers are an error; an empty table gives no
rows; extra columns are ignored; sets whose 64-bit name collides raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.llm.common import arrow_rows, materialize, row_identity
from tapeline.llm.components import components
from tapeline.llm.substrings import _Hashes

MOST_FREQUENT = 1 << 16
FREQUENT = 32
STEP = 24
FAR = 0.5  # Jaccard distance from a head up to which a set counts as near it
LONG = 16  # sets in a list; a longer one is only used among sets that have many such
MOST_SUBSETS = 64  # a set with more goes to the lists, whatever their cost
SALTS = 16
SALT_ROWS = 1 << 15
HEADS = 3
SLICE = 400
COUNTED_AT_ONCE = 2 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: _Hashes, text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of the words, A-Z in lower case."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter([hashes[w] for w in words], np.uint64, len(words))
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(words))], np.uint64)
    x = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = (x ^ (x >> np.uint64(31))) * _ODD[k % len(_ODD)] + h[k : k + len(x)]
    return np.unique(_mix(x))


class Rule:
    """The threshold num / den and what follows from it."""

    def __init__(self, num: int, den: int, boundary: int = 0):
        self.num, self.den, self.boundary = num, den, boundary

    def need(self, size: int) -> int:
        """The least overlap of a set of ``size`` with any set that links with it."""
        return -(-self.num * size // self.den)

    def prefix(self, size: int, k: int) -> int:
        return min(size, size - self.need(size) + k)

    def extra(self, size: int) -> int:
        """Elements over one that a set shares with any partner in the lists. None near the small sets."""
        return size // STEP if self.num * size > self.den * self.boundary else 0

    def subsets(self, size: int) -> int:
        p = self.prefix(size, 2)
        return p * (p - 1) // 2

    def small(self, size: int) -> bool:
        return size <= self.boundary

    def listed(self, size: int) -> bool:
        """Sets that can link with one over the boundary, or with one that needs fewer than two common elements."""
        single = self.den // self.num  # sizes up to this need an overlap of 1 only
        return size * self.den >= self.num * (self.boundary + 1) or size * self.num <= single * self.den

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def choose_boundary(rule: Rule, mean_list: float) -> int:
    """The largest size up to which all sizes have subsets no dearer than their lists."""
    size = 0
    while True:
        s = size + 1
        if rule.subsets(s) > min(MOST_SUBSETS, rule.prefix(s, 1) * (1 + mean_list)):
            return size
        size = s


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn``: from an iterator of column lists to dicts of columns, over slices of Arrow batches."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    part = b.slice(at, SLICE)
                    yield [part.column(i).to_pylist() for i in range(part.num_columns)]

        for cols in fn(slices()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return arrow_rows(df, run, fields)


def _survey(rows: DataFrame, n: int) -> DataFrame:
    """One pass over all texts: kind 0: (row, key, id, check, size) of each document; 1: (id: element, size: count) of
    elements that a task met often; 2: the same for all elements of a fixed 1/256 of the hash range."""

    def fn(slices):
        hashes, held, count = _Hashes(), [], 0

        def often():
            x, c = np.unique(np.concatenate(held), return_counts=True)
            some = x >> np.uint64(56) == 0
            for kind, pick in ((1, c >= 3), (2, some)):
                y = x[pick].view(np.int64)
                zero = np.zeros(len(y), np.int64)
                yield [zero + kind, zero, zero, y, zero, c[pick]]

        for docs, keys, texts in slices:
            out: list[list] = [[], [], [], [], [], []]
            for row, key, text in zip(docs, keys, texts, strict=True):
                x = shingles(hashes, text, n)
                raw = x.tobytes()
                name = xxhash.xxh3_64_intdigest(raw) - (1 << 63) if len(x) else None
                for o, v in zip(out, (0, row, key, name, xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63), len(x)), strict=True):
                    o.append(v)
                held.append(x)
                count += len(x)
            yield out
            if count > COUNTED_AT_ONCE:
                yield from often()
                held, count = [], 0
        if held:
            yield from often()

    return _arrow(rows, fn, "kind long, row long, key long, id long, check long, size long")


def _keys(rows: DataFrame, n: int, rule: Rule, frequent: object) -> DataFrame:
    """(k, salt, id): what each set is found by. Frequent elements are salted; a task gives each set once."""

    def fn(slices):
        hashes, (heavy, salts), done = _Hashes(), frequent.value, set()
        for (texts,) in slices:
            out: list[list[np.ndarray]] = [[], [], []]
            for at, text in enumerate(texts):
                x = shingles(hashes, text, n)
                if not len(x):
                    continue
                name = xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)
                if name in done:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(name)
                add(out, x, name, heavy, salts)
            if out[0]:
                yield [np.concatenate(o) for o in out]

    def add(out, x, name, heavy, salts):
        # 0 for elements that are not frequent, else how many salts their keys are dealt over
        many = np.zeros(len(x), np.int64)
        if len(heavy):
            where = np.minimum(np.searchsorted(heavy, x), len(heavy) - 1)
            many = np.where(heavy[where] == x, salts[where], 0)
        late = many > 0
        order = np.argsort(late, kind="stable")
        size = len(x)
        k, busy = [], []
        if rule.listed(size) or not rule.small(size):
            p = order[: rule.prefix(size, 1 + rule.extra(size))]
            k.append(_mix(x[p] ^ np.uint64(1)))
            busy.append(many[p])
        if rule.small(size):
            p = order[: rule.prefix(size, 2)]
            i, j = np.triu_indices(len(p), 1)
            lo, hi = np.minimum(x[p][i], x[p][j]), np.maximum(x[p][i], x[p][j])
            k.append(_mix(_mix(lo) * _ODD[0] + hi))
            busy.append(np.minimum(many[p][i], many[p][j]))
        k, busy = np.concatenate(k), np.concatenate(busy)
        out[0].append(k.view(np.int64))
        out[1].append(np.where(busy > 0, name % np.maximum(busy, 1), -1).astype(np.int32))
        out[2].append(np.full(len(k), name, np.int64))

    return _arrow(rows, fn, "k long, salt int, id long")


def _blobs(rows: DataFrame) -> DataFrame:
    """(row, key, blob): texts compressed for the way through the shuffle."""

    def fn(slices):
        z = zstandard.ZstdCompressor(level=1)
        for docs, keys, texts in slices:
            yield [docs, keys, [z.compress((t or "").encode("utf-8", "replace")) for t in texts]]

    return _arrow(rows, fn, "row long, key long, blob binary")


def _verify(pairs: DataFrame, sets: DataFrame, n: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link. sets: (id, blob)."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("blob").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("blob").alias("y")), "b").select("a", "b", "x", "y")

    def fn(slices):
        z, hashes = zstandard.ZstdDecompressor(), _Hashes()
        kept: dict[int, np.ndarray] = {}

        def get(name, blob):
            if (x := kept.get(name)) is None:
                if len(kept) > 200:
                    kept.clear()
                x = kept[name] = shingles(hashes, z.decompress(blob).decode(), n)
            return x

        for one, two, xs, ys in slices:
            found = [(a, b) for a, b, x, y in zip(one, two, xs, ys, strict=True) if rule.link(get(a, x), get(b, y))]
            if found:
                yield [list(c) for c in zip(*found, strict=True)]

    return _arrow(both, fn, "a long, b long")


def _compare(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(a, b, na, nb, both, added): sizes, common elements, and what b adds to a where the two are near."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("blob").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("blob").alias("y")), "b").select("a", "b", "x", "y")

    def fn(slices):
        z, hashes = zstandard.ZstdDecompressor(), _Hashes()
        kept: dict[int, np.ndarray] = {}
        for one, two, xs, ys in slices:
            out: list[list] = [[], [], [], [], [], []]
            for a, b, x, y in zip(one, two, xs, ys, strict=True):
                if a not in kept:
                    if len(kept) > 200:
                        kept.clear()
                    kept[a] = shingles(hashes, z.decompress(x).decode(), n)
                p, r = kept[a], shingles(hashes, z.decompress(y).decode(), n)
                added = np.setdiff1d(r, p, assume_unique=True)
                same = len(r) - len(added)
                near = len(p) + len(r) - same <= same / (1 - FAR) + 1e-9
                for o, v in zip(out, (a, b, len(p), len(r), same, added.view(np.int64) if near else []), strict=True):
                    o.append(v)
            yield out

    return _arrow(both, fn, "a long, b long, na long, nb long, both long, added array<long>")


def similar_sets(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Documents (``row_identity`` and id, size) and components (id, component) of sets that link with another one."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(*row_identity(docs), "text")
    seen = materialize(_survey(rows, n))
    common = seen.filter("kind = 1").groupBy("id").agg(F.sum("size").alias("c")).filter(F.col("c") >= FREQUENT)
    top = common.orderBy(F.desc("c"), "id").limit(MOST_FREQUENT).toArrow()
    name, count = top["id"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    by_name = np.argsort(name)
    frequent = sc.broadcast((name[by_name], np.clip(count[by_name] // SALT_ROWS, SALTS, 1 << 20)))
    lists = seen.filter("kind = 2").groupBy("id").agg(F.sum("size").alias("c")).filter(F.col("c") < FREQUENT)
    load = lists.agg(F.sum(F.col("c").cast("double") * F.col("c")), F.sum("c")).first()
    rule = Rule(num, den)
    rule = Rule(num, den, choose_boundary(rule, (load[0] / load[1] - 1) if load[1] else 0.0))
    names = seen.filter("kind = 0").select("row", "key", "id", "check", "size")
    sets = names.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("row", "key")).alias("at"), F.min("size").alias("size"), F.min("check").alias("c1"), F.max("check").alias("c2"))
    clash = F.when(F.col("c1") != F.col("c2"), F.raise_error(F.lit("two sets have one name"))).otherwise(F.col("size"))
    sets = materialize(sets.select("id", "at.row", "at.key", clash.alias("size")))

    keys = _keys(rows.select("text"), n, rule, frequent)
    by = Window.partitionBy("k", "salt")
    met = keys.withColumns({"rep": F.min("id").over(by), "top": F.max("id").over(by)})
    met = materialize(met.filter("rep != top or salt >= 0").select("k", "salt", "id", "rep").distinct())
    sizes = sets.select("id", "size")
    extra = lambda c: F.when(F.col(c) * num > den * rule.boundary, F.floor(F.col(c) / STEP)).otherwise(0)
    # what a partner of least size shares over one element
    slack = F.when(F.col("size") * num * num > den * den * rule.boundary, F.floor(F.floor(F.col("size") * num / den) / STEP)).otherwise(0)

    def sized(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b")
        return p.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

    # first each set with one other: the smallest of most of its lists; heavy lists' heads with each other
    heads = met.filter("salt >= 0").select("k", "rep").distinct()
    firsts = heads.groupBy("k").agg(F.min("rep").alias("first"))
    across = heads.join(firsts, "k").select(F.col("rep").alias("b"), F.col("first").alias("a"))
    near = met.select(F.col("id").alias("b"), F.col("rep").alias("a")).unionByName(across).filter("a != b").groupBy("a", "b").agg(F.count("*").alias("n"))
    likely = sized(near).filter(2 * F.col("n") > F.least(extra("na"), extra("nb")))
    best = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    first_pairs = materialize(likely.withColumn("r", F.row_number().over(best)).filter("r = 1").select("a", "b"))
    listed = met.select("id").distinct().join(sets, "id").select("id", "row", "key")
    texts = materialize(_blobs(rows).join(listed, ["row", "key"]).groupBy("id").agg(F.first("blob").alias("blob")))
    links = materialize(_verify(first_pairs, texts, n, rule).distinct())
    parts = materialize(components(links))

    # sets of one list that are still apart
    at = met.select("k", "id").distinct().join(parts, "id", "left").select("k", "id", F.coalesce("component", "id").alias("part"))
    at = materialize(at.join(sizes, "id"))
    open_keys = at.groupBy("k").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("sets")).filter("p != q")
    left = materialize(at.join(open_keys.select("k", "sets"), "k"))
    dropped = left.groupBy("id").agg(F.sum((F.col("sets") > LONG).cast("int")).alias("dropped"))
    left = materialize(left.join(dropped, "id").withColumn("hot", F.col("dropped") > slack))

    def apart(rows: DataFrame, spared: bool, one_is_enough: bool = False) -> DataFrame:
        """Pairs of one list and of different components that share as much of their prefixes as they must."""
        one, two = (rows.select("k", *[F.col(c).alias(f"{c}{i}") for c in ("id", "part", "size", "dropped")]) for i in (1, 2))
        met_in = one.join(two, "k").filter((F.col("part1") < F.col("part2")) & (F.least("size1", "size2") * den >= F.greatest("size1", "size2") * num))
        aside = F.least("dropped1", "dropped2") if spared else F.lit(0)
        must = F.lit(1) if one_is_enough else 1 + F.least(extra("size1"), extra("size2")) - aside
        pairs = met_in.groupBy(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).agg(F.count("*").alias("n"), F.first(must).alias("must"))
        return pairs.filter(F.col("n") >= F.col("must")).select("a", "b")

    # sets with many long lists: each against the heads of its lists; those far from them against heads of their own
    hot = left.filter("hot")
    waiting = hot.filter(F.col("sets") > LONG).select("k", "id", "dropped", "size")
    nears, links_now, fars = [], links, None
    for turn in range(HEADS):
        heads = materialize(waiting.groupBy("k").agg(F.max_by("id", F.struct(F.col("dropped") / F.col("size"), "id")).alias("head")))  # so that a long list can be split
        headed = materialize(waiting.join(heads, "k"))
        compared = materialize(_compare(headed.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), texts, n))
        nears.append(compared)
        gap = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
        beyond = compared.filter(gap >= FAR - (1 - num / den) - 1e-9).select(F.col("b").alias("id"), F.col("a").alias("head"))
        fars = materialize(headed.join(beyond, ["id", "head"]).select("k", "id", "dropped", "size"))
        crowded = fars.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > LONG).select("k")
        if turn == HEADS - 1 or crowded.isEmpty():
            break
        waiting = fars
    compared = nears[0]
    for more in nears[1:]:
        compared = compared.unionByName(more)
    found = compared.filter(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
    links = materialize(links_now.unionByName(found).distinct())
    parts = materialize(components(links))
    placed = lambda df: df.drop("part").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    left = materialize(placed(left))
    still = materialize(left.groupBy("k").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("k"))
    left = materialize(left.join(still, "k", "left_semi"))
    rest = apart(left.filter(F.col("sets") <= LONG), True)
    # far from all heads, in pairs
    gap = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    at_head = compared.select(F.col("b").alias("id"), F.col("a").alias("head"), gap.alias("gap"), "na", "nb", (F.col("na") - F.col("both")).alias("d"), "added")
    far = left.filter("hot").join(fars.select("k", "id"), ["k", "id"], "left_semi")
    far_keys = materialize(far.select("k", "id").distinct().groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"))
    rest = rest.unionByName(apart(far.join(far_keys, "k", "left_semi"), False, one_is_enough=True))
    # near the head: by what they add, or by classes of size and lack
    close = materialize(placed(at_head.filter(F.col("gap") <= FAR)))
    fits = lambda lack, x: (num + den) * (F.col("na") - lack + x) >= num * (F.col("nb1") + F.col("nb2"))
    adds = close.select("head", "na", "id", "part", "nb", "d", F.explode("added").alias("t"))
    busy = materialize(adds.groupBy("head", "t").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("c")).filter("p != q").select("head", "t", "c"))
    own = Window.partitionBy("head", "id")
    adds = adds.join(busy, ["head", "t"]).withColumns({"pos": F.row_number().over(own.orderBy("c", "t")), "a": F.count("*").over(own)})
    adds = materialize(adds.drop("c"))
    one, two = (adds.select("head", "t", "na", *[F.col(c).alias(f"{c}{i}") for c in ("id", "part", "nb", "d", "pos", "a")]) for i in (1, 2))
    # a pair that must add so many common elements has one of them early in both orders, rare before frequent
    lacking = F.ceil(num * (F.col("nb1") + F.col("nb2")) / (num + den) - 1e-9) - F.col("na") + F.greatest("d1", "d2")
    early = (F.col("pos1") <= F.col("a1") - lacking + 1) & (F.col("pos2") <= F.col("a2") - lacking + 1)
    by_added = one.join(two.drop("na"), ["head", "t"]).filter((F.col("part1") < F.col("part2")) & (lacking >= 1) & early)
    kinds = close.groupBy("head", "na", "nb", "d").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    one, two = (kinds.select("head", "na", *[F.col(c).alias(f"{c}{i}") for c in ("nb", "d", "p", "q")]) for i in (1, 2))
    classes = one.join(two.drop("na"), "head").filter(fits(F.greatest("d1", "d2"), F.lit(0)) & ((F.col("p1") != F.col("q2")) | (F.col("q1") != F.col("p2")))).select("head", "nb1", "d1", "nb2", "d2")
    one, two = (close.select("head", *[F.col(c).alias(f"{c}{i}") for c in ("id", "part", "nb", "d")]) for i in (1, 2))
    by_class = materialize(classes).join(one, ["head", "nb1", "d1"]).join(two, ["head", "nb2", "d2"]).filter("part1 < part2")
    named = [x.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")) for x in (by_added, by_class)]
    rest = rest.unionByName(named[0]).unionByName(named[1]).distinct()
    tried = first_pairs.unionByName(compared.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"))
    more = materialize(_verify(rest, texts, n, rule).distinct())
    if more.isEmpty():
        return names, parts
    return names, materialize(components(links.unionByName(more)))


def similarity_classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per document row: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    names, parts = similar_sets(docs, n, num, den)
    own = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("row"))
    named = names.join(parts, "id", "left").select(own.alias("doc_id"), "size", F.coalesce("component", "id").alias("part"))
    first = materialize(named.filter(F.col("part").isNotNull()).groupBy("part").agg(F.min("doc_id").alias("first")))
    done = named.join(first, "part", "left")
    return done.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component, of those with the smallest id (null ids first), and all rows whose sets are empty.

    Rows are told apart by id and text, so an id may stand for several texts; of rows with equal ids and texts one stays.
    """
    names, parts = similar_sets(docs, n, num, den)
    sets = names.filter(F.col("id").isNotNull()).groupBy("id", "row", "key").agg(F.count("*").alias("n"))
    firsts = sets.groupBy("id").agg(F.min(F.struct((F.col("key").bitwiseAND(F.lit(1)) == 0).alias("named"), "row", "key", "n")).alias("at"))
    placed = firsts.join(parts, "id", "left").groupBy(F.coalesce("component", "id").alias("part")).agg(F.min("at").alias("at"))
    chosen = materialize(placed.select(F.col("at.row").alias("_row"), F.col("at.key").alias("_key"), F.col("at.n").alias("_n")))
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    row, key = row_identity(docs)
    empty = F.coalesce(~F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(True))  # the blanks between words of bytes
    keyed = docs.select(row.alias("_row"), key.alias("_key"), empty.alias("_empty"), *[docs[f"`{c}`"].alias(x) for c, x in zip(docs.columns, columns, strict=True)])
    full = keyed.filter("not _empty")
    once = full.join(chosen.filter("_n = 1"), ["_row", "_key"], "left_semi").select(*columns)
    # rows that occur more than once meet in each task first; which of them stays is set by a hash of their other columns
    again = full.join(chosen.filter("_n > 1"), ["_row", "_key"], "left_semi")
    rank = F.xxhash64(*[c for c, kind in keyed.select(*columns).dtypes if "map<" not in kind])
    again = again.groupBy("_row", "_key").agg(F.min_by(F.struct(*columns), rank).alias("v")).select("v.*")
    return keyed.filter("_empty").select(*columns).unionByName(once).unionByName(again).toDF(*docs.columns)
