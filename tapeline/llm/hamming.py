"""Exact top-k search among binary codes by incremental multi-index hashing.

A vector's code has a bit for the sign of each of its dimensions, of any number. Each distinct code is kept once, with
its k + 1 smallest ids, so a vector that many rows share is one entry. A code is cut into m segments, about as many bits
each as the number of codes has, and is indexed once for each segment, by (segment, first bits of its value).

The search goes in rounds for all queries together. In round r each open query is joined with the index on the segment
values at distance r from its own: the first bits are enumerated on the way to the join, the rest within the joined
groups. What is met there is verified by its whole distance, and a query's best are merged over all groups, so each query
has one kth distance. After round r every code within m * (r + 1) - 1 has been met in some segment, so a query whose kth
verified distance is no greater is done, with all ties. A code is taken where its first nearest segment is searched,
hence once. Where the values at a radius outnumber the codes, enumerating them would cost more than looking at each
code: the queries still open are then compared with all codes, in blocks, which is exact as well.

Index groups of more than ``INDEX_BLOCK`` entries (many codes may share a segment value) are split by a hash, and so are
queries of more than ``QUERY_BLOCK``, so no group is unbounded.

Edge cases: rows with a null id or vector, or a null inside it, are neither found nor ask; zeros count as not positive; a
shorter vector lacks positive dimensions at its end; ties go to the smaller id; a row does not find itself but finds
others with its code; with fewer than k others, all are returned; repeated rows of one id count as one; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.llm.common import arrow_rows, discard, materialize, ship

INDEX_BLOCK = 1 << 16
QUERY_BLOCK = 1 << 13
AT_ONCE = 1 << 18  # segment values, or compared pairs, that are handled together


@dataclass(frozen=True)
class Shape:
    """How codes of ``size`` bytes are cut: segment s has the bits from starts[s] to starts[s + 1], its first ``high`` ones are in the key."""

    size: int
    starts: tuple[int, ...]
    high: int

    @property
    def m(self) -> int:
        return len(self.starts) - 1

    def width(self, s: int) -> int:
        return self.starts[s + 1] - self.starts[s]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """(n, bits) of (n, size) bytes."""
        return np.unpackbits(codes, axis=1, bitorder="little")

    def values(self, bits: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``high`` bits of segment s as a number, and the rest of it."""
        part = bits[:, self.starts[s] : self.starts[s + 1]].astype(np.int64)
        whole = part @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64))
        h = min(self.high, part.shape[1])
        return whole & ((1 << h) - 1), whole >> h


def shape_of(bits: int, n: int) -> Shape:
    size = max(1, -(-bits // 8))
    m = max(1, round(8 * size / max(8, min(32, math.log2(max(2, n))))))
    starts = tuple(8 * size * s // m for s in range(m + 1))
    least = min(b - a for a, b in itertools.pairwise(starts))
    return Shape(size, starts, min(least, max(3, math.ceil(math.log2(max(1, n) / INDEX_BLOCK)))))


@lru_cache(maxsize=64)
def _masks(width: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), weight)], np.int64)


def sign_codes(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, code): bit i of the code is set where dimension i is positive; trailing zero bytes are cut, so lengths may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for v in b.column(1):
                x = None if not v.is_valid else v.values
                if x is None or x.null_count:
                    codes.append(None)
                    continue
                codes.append(np.packbits(x.to_numpy(zero_copy_only=False) > 0, bitorder="little").tobytes().rstrip(b"\0"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["id", "code"])

    return arrow_rows(vectors.select(F.col(id_column).cast("long").alias("id"), vector), run, "id long, code binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    raw = b"".join(x.ljust(size, b"\0") for x in column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, size)


def _index(entries: DataFrame, shape: Shape) -> DataFrame:
    """(seg, high, code, ids): each entry once for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = shape.bits(_matrix(b.column(0), shape.size))
            for s in range(shape.m):
                high, _ = shape.values(bits, s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, s, np.int32)), pa.array(high), b.column(0), b.column(1)], names=["seg", "high", "code", "ids"])

    return arrow_rows(entries, run, "seg int, high long, code binary, ids array<long>")


def _asked(queries: DataFrame, shape: Shape, radius: int) -> DataFrame:
    """(seg, high, left, code, kth): where a query's values at this distance begin, and the distance left for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = shape.bits(_matrix(b.column(0), shape.size))
            for s in range(shape.m):
                own, _ = shape.values(bits, s)
                h = min(shape.high, shape.width(s))
                for first in range(min(radius, h) + 1):
                    if radius - first > shape.width(s) - h:
                        continue
                    masks = _masks(h, first)
                    high = (own[:, None] ^ masks[None, :]).ravel()
                    who = pa.array(np.repeat(np.arange(len(own)), len(masks)))
                    n = len(high)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int32)), pa.array(high), pa.array(np.full(n, radius - first, np.int32)), b.column(0).take(who), b.column(1).take(who)], names=["seg", "high", "left", "code", "kth"])

    return arrow_rows(queries, run, "seg int, high long, left int, code binary, kth int")


class _Best:
    """The k nearest ids of each query of one group, ties by id."""

    def __init__(self, index: pa.Table, k: int):
        ids = index["ids"].combine_chunks()
        self.flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        self.offsets, self.k = offsets - offsets[0], k
        self.found: list[np.ndarray] = []

    def add(self, who: np.ndarray, entry: np.ndarray, dist: np.ndarray) -> None:
        c = np.diff(self.offsets)[entry]
        pos = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.offsets[entry], c)
        self.found.append(np.stack([np.repeat(who, c), np.repeat(dist, c), self.flat[pos]]))
        if sum(f.shape[1] for f in self.found) > 4 * AT_ONCE:
            self.found = [self.cut()]

    def cut(self) -> np.ndarray:
        if not self.found:
            return np.zeros((3, 0), np.int64)
        who, dist, ids = np.concatenate(self.found, 1)
        order = np.lexsort((ids, dist, who))
        who, dist, ids = who[order], dist[order], ids[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        return np.stack([who[top], dist[top], ids[top]])

    def table(self, codes: pa.Array) -> pa.Table:
        who, dist, ids = self.cut()
        return pa.table({"code": codes.take(pa.array(who)), "near": pa.array(ids, pa.int64()), "distance": pa.array(dist, pa.int64())})


def _search(shape: Shape, k: int, radius: int):
    """For one group of the index and the queries that reach it."""

    def run(key, index: pa.Table, queries: pa.Table) -> pa.Table:
        codes = queries["code"].combine_chunks()
        best = _Best(index, k)
        if index.num_rows and queries.num_rows:
            s = key[0].as_py()
            mine, asked = (_matrix(t["code"].combine_chunks(), shape.size) for t in (index, queries))
            bits = shape.bits(mine)
            rest = shape.values(bits, s)[1]
            order = np.argsort(rest, kind="stable")
            rest, mine = rest[order], mine[order]
            qbits = shape.bits(asked)
            own = shape.values(qbits, s)[1]
            left, kth = queries["left"].to_numpy(), queries["kth"].to_numpy()
            for weight in np.unique(left):
                masks = _masks(shape.width(s) - min(shape.high, shape.width(s)), int(weight))
                some = np.flatnonzero(left == weight)
                step = max(1, AT_ONCE // len(masks))
                for at in range(0, len(some), step):
                    who = some[at : at + step]
                    values = (own[who][:, None] ^ masks[None, :]).ravel()
                    lo, hi = np.searchsorted(rest, values, "left"), np.searchsorted(rest, values, "right")
                    size = hi - lo
                    for part in _cuts(size):
                        n = size[part]
                        total = int(n.sum())
                        if not total:
                            continue
                        row = np.repeat(np.repeat(who, len(masks))[part], n)
                        entry = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)
                        diff = asked[row] ^ mine[entry]
                        dist = np.bitwise_count(diff).sum(1, dtype=np.int64)
                        ok = dist <= kth[row]
                        row, entry, dist, diff = row[ok], entry[ok], dist[ok], diff[ok]
                        # taken in the first segment that is nearest
                        apart = shape.bits(diff)
                        first = np.ones(len(row), bool)
                        for t in range(shape.m):
                            if t != s:
                                d = apart[:, shape.starts[t] : shape.starts[t + 1]].sum(1, dtype=np.int64)
                                first &= d > radius if t < s else d >= radius
                        best.add(row[first], order[entry[first]], dist[first])
        return best.table(codes)

    return run


def _cuts(size: np.ndarray) -> Iterator[slice]:
    """Consecutive runs of about ``AT_ONCE`` together."""
    ends = np.cumsum(size)
    at, done = 0, 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        yield slice(at, end)
        done, at = int(ends[end - 1]), end


def _scan(shape: Shape, k: int):
    """All queries of a group against all its entries."""

    def run(key, index: pa.Table, queries: pa.Table) -> pa.Table:
        codes = queries["code"].combine_chunks()
        best = _Best(index, k)
        if index.num_rows and queries.num_rows:
            mine, asked = (_matrix(t["code"].combine_chunks(), shape.size) for t in (index, queries))
            step = max(1, AT_ONCE // len(mine))
            for at in range(0, len(asked), step):
                part = asked[at : at + step]
                dist = sum(np.bitwise_count(part[:, None, b] ^ mine[None, :, b]).astype(np.int64) for b in range(shape.size))
                row, entry = np.divmod(np.arange(dist.size), len(mine))
                best.add(row + at, entry, dist.ravel())
                best.found = [best.cut()]
        return best.table(codes)

    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, rank, neighbour, distance): for each query (id, code) the k nearest others of ``codes`` (id, code)."""
    spark = codes.sparkSession
    ship(spark)
    known = lambda df: df.filter(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code").distinct()
    codes, queries = known(codes), known(queries)
    first = codes.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = materialize(first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n, most = entries.agg(F.count("*"), F.max(F.octet_length("code"))).first()
    shape = shape_of(8 * max(most or 1, queries.agg(F.max(F.octet_length("code"))).first()[0] or 1), n)
    far = 8 * shape.size + 1
    index = materialize(_index(entries, shape))
    sizes = index.groupBy("seg", "high").agg(F.count("*").alias("n"))
    groups = materialize(sizes.select("seg", "high", F.ceil(F.col("n") / INDEX_BLOCK).cast("int").alias("blocks")))
    split = index.join(groups, ["seg", "high"]).withColumn("b", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")).select("seg", "high", "b", "code", "ids")
    asked = materialize(queries.select("code").distinct())
    still = materialize(asked.withColumn("kth", F.lit(far)))
    best = None

    def merge(found: DataFrame) -> DataFrame:
        every = found if best is None else best.unionByName(found)
        top = every.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("distance", "near"))).filter(F.col("r") <= k + 1)
        return materialize(top.drop("r"))

    for radius in range(max(shape.width(s) for s in range(shape.m)) + 1):
        n_open = still.count()
        if not n_open:
            break
        values = sum(math.comb(shape.width(s), radius) for s in range(shape.m))
        if values > max(n, 64):
            blocks, parts = max(1, math.ceil(n / INDEX_BLOCK)), max(1, math.ceil(n_open / QUERY_BLOCK))
            left = entries.withColumn("b", F.pmod(F.xxhash64("code"), F.lit(blocks))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            right = still.withColumn("p", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
            found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(_scan(shape, k + 1), "code binary, near long, distance long")
            done = still.select("code")
            best = None if best is None else materialize(best.join(done, "code", "left_anti"))
            best = merge(found)
            break
        # a group's queries are split where there are many, each part with its own copy of the index group
        reach = n_open * sum(math.comb(shape.high, j) for j in range(min(radius, shape.high) + 1)) / 2**shape.high
        parts = max(1, math.ceil(reach / QUERY_BLOCK))
        right = _asked(still, shape, radius).join(groups, ["seg", "high"]).withColumn("p", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        left = split.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else split.withColumn("p", F.lit(0))
        keys = ["seg", "high", "b", "p"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(shape, k + 1, radius), "code binary, near long, distance long")
        last, best = best, merge(found)
        kths = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        kth = F.when(F.col("n") > k, F.col("d")).otherwise(far)
        old, still = still, materialize(still.select("code").join(kths, "code", "left").select("code", F.coalesce(kth, F.lit(far)).cast("int").alias("kth")).filter(F.col("kth") >= shape.m * (radius + 1)))
        discard(*(x for x in (last, old) if x is not None))
    if best is None:
        best = spark.createDataFrame([], "code binary, near long, distance long")
    lists = best.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "near"))).alias("best"))
    own = queries.join(lists, "code").select("id", F.slice(F.filter("best", lambda x: x["near"] != F.col("id")), 1, k).alias("best"))
    return own.select("id", F.posexplode("best").alias("place", "hit")).select("id", (F.col("place") + 1).cast("long").alias("rank"), F.col("hit.near").alias("neighbour"), F.col("hit.distance").alias("distance"))


def nearest_report(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The search of every row whose id is divisible by 20 against all rows."""
    codes = materialize(sign_codes(vectors, "vec_id", "embedding"))
    return top_k(codes, codes.filter(F.col("id") % 20 == 0), k).withColumnRenamed("id", "vec_id")
