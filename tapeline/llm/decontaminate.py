"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``width`` consecutive words of a benchmark item (the whole item if it is shorter). Patterns of
one length share a shift table over blocks of two words: the block at the end of the search window says how far the
window may move without passing an occurrence. Where the shift is 0, the bucket of that last block names the patterns
that end with it, as places in the items, and these are compared word by word.

Words are numbered per shard, so a pattern costs two table entries and no copy of its words. Items are cut into pieces of
``PIECE`` windows (pieces overlap, windows do not) and dealt into shards of at most about ``SHARD_BYTES`` of text, some
300 bytes of tables a word, so each broadcast has a fixed bound whatever the benchmark's size. More shards mean more
passes over the documents; then rows are numbered and written once, and each pass returns the rows with hits alone.

Edge cases: null or empty text has no words and no hits; an item without words has no window; an item with a null id
marks words but is not listed; repeated rows are searched each; an empty table gives no rows, an empty benchmark no hits;
other columns are ignored, or pass through ``drop_leaks``, whatever they are called.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import arrow_rows, map_rows, materialize

SHARD_BYTES = 4 << 20
PIECE = 20_000
WIDTH = 10

#: Bytes that are not in a word become spaces, A-Z becomes a-z. Bytes from 0x80 on belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class ShiftTable:
    """Wu-Manber tables of patterns that all have ``length`` words: places (item, start) in ``items``, lists of word numbers."""

    def __init__(self, length: int, patterns: list[tuple[int, int]], items: list[list[int]], base: int):
        self.length, self.block, self.items, self.base = length, min(2, length), items, base
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, start in patterns:
            words = items[item]
            for end in range(start + self.block, start + length + 1):
                key = self.key(words, end)
                move = start + length - end
                if move < self.shift.get(key, self.default):
                    self.shift[key] = move
            self.buckets[key].append((item, start))

    def key(self, words: list[int], end: int) -> int:
        return words[end - 2] * self.base + words[end - 1] if self.block == 2 else words[end - 1]

    def search(self, words: list[int], hit: set[int], found: set[int]) -> None:
        length, base, default, shift, two = self.length, self.base, self.default, self.shift.get, self.block == 2
        at, n = length, len(words)
        while at <= n:
            key = words[at - 2] * base + words[at - 1] if two else words[at - 1]
            if move := shift(key, default):
                at += move
                continue
            for item, start in self.buckets[key]:
                if words[at - length : at] == self.items[item][start : start + length]:
                    hit.update(range(at - length, at))
                    found.add(item)
            at += 1


class Tables:
    """The tables of one shard of pieces (name, text). Number 0 stands for all words that no piece has."""

    def __init__(self, pieces: list[tuple[str | None, str | None]], width: int):
        self.names = [name for name, _ in pieces]
        self.ids: dict[bytes, int] = {}
        items = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)] for _, text in pieces]
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, words in enumerate(items):
            for at in range(max(1, len(words) - width + 1) if words else 0):
                by_length[min(width, len(words))].append((i, at))
        self.tables = [ShiftTable(n, p, items, len(self.ids) + 1) for n, p in sorted(by_length.items())]

    def search(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Words, places of covered words and names of items with occurrences."""
        words, hit, found = words_of(text), set(), set()
        numbers = [self.ids.get(w, 0) for w in words]
        for t in self.tables:
            t.search(numbers, hit, found)
        return len(words), sorted(hit), sorted({self.names[i] for i in found if self.names[i] is not None})


def pieces_of(benchmark: DataFrame, width: int, step: int = PIECE) -> DataFrame:
    """(item_id, text): every window of an item in one of its pieces; an item of fewer words than a window is one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                cut = [b" ".join(words[at : at + step + width - 1]).decode() for at in range(0, max(1, len(words) - width + 1), step)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array(cut, pa.string())], names=["item_id", "text"])

    return arrow_rows(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), run, "item_id string, text string")


def _scan(docs: DataFrame, keep: list[str], tables: object, hits_only: bool = False) -> DataFrame:
    def run(slices: Iterator[dict]) -> Iterator[list[tuple]]:
        ready = tables.value
        for rows in slices:
            found = ((*kept, *ready.search(text)) for text, *kept in zip(rows["text"], *(rows[c] for c in keep), strict=True))
            yield [row for row in found if row[-2] or not hits_only]

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long", "hits array<int>", "items array<string>"])
    return map_rows(docs, keep if "text" in keep else [*keep, "text"], run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document row: ``keep`` columns, n_words, hits (places of covered words) and items (ids with occurrences)."""
    sc = docs.sparkSession.sparkContext
    keep = keep or ["doc_id"]
    pieces = materialize(pieces_of(benchmark, width))
    size = pieces.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    if shards == 1:
        return _scan(docs, keep, sc.broadcast(Tables([tuple(r) for r in pieces.collect()], width)))
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    union = None
    for k in range(shards):
        mine = pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        sent = sc.broadcast(Tables([tuple(r) for r in mine.collect()], width))
        part = materialize(_scan(numbered, ["_row"], sent, hits_only=True))
        sent.unpersist()
        union = part if union is None else union.unionByName(part)
    met = union.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = sc.broadcast(Tables([], width))
    every = _scan(numbered, [*keep, "_row"], none).drop("hits", "items").join(met, "_row", "left")
    return every.select(*keep, "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def leak_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    found = find_leaks(docs, benchmark, width)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any word inside an occurrence, with their own columns."""
    names = [c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]  # whatever the columns are called, nothing clashes
    found = find_leaks(docs.toDF(*names), benchmark, width, keep=names)
    return found.filter(F.size("hits") == 0).select(*names).toDF(*docs.columns)
