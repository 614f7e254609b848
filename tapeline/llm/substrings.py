"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every ``LENGTH`` consecutive words, the ``SEED``-word sequence with the smallest hash is
an anchor, so equal windows have equal anchors at equal places. Each anchor is extended both ways over all windows that
it stands for; the extension's hash joins anchors with the same surroundings. Where that whole extension occurs again,
all its windows repeat. Where only the anchor does, one occurrence of each different extension gives the hashes of its
windows, and windows that two extensions share repeat. Adjacent repeated windows form a maximal repeat; the words that
they cover are removed.

Counts are summed before they are dealt out, occurrences are joined with the counts of their own extension, and no two
occurrences are ever paired, so a passage of many copies costs as much as as many different ones. Extensions of one
anchor, and windows, are compared by 128 bits of hash.

Edge cases: null or empty text has no words; texts shorter than a window lose nothing; repeated rows are repeats of each
other, and so are equal passages of one document; rows of one id with different texts, and rows with null ids, are told
apart by 63 bits of hash of the text; ids may be of any type; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import arrow_rows, discard, materialize, row_identity

LENGTH = 35
SEED = 8
KEPT_WORDS = 200_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd multipliers of the rolling hashes


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII space characters, unchanged."""
    return text.encode("utf-8", "replace").split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Roller:
    """Rolling hashes of word ranges, by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.words = _Hashes()
        self.powers: list[np.ndarray] = []
        self.inverses: list[np.ndarray] = []

    def _grow(self, n: int) -> None:
        if self.powers and len(self.powers[0]) > n:
            return
        size = max(4096, 2 * n)
        self.powers, self.inverses = [], []
        for m in _ODD:
            for value, out in ((m, self.powers), (pow(m, -1, 1 << 64), self.inverses)):
                x = np.full(size, value, np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))

    def prefix(self, words: list[bytes]) -> list[np.ndarray]:
        self._grow(len(words) + 1)
        get = self.words
        h = np.fromiter([get[w] for w in words], np.uint64, len(words))
        out = []
        for p in self.powers:
            s = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(h * p[: len(words)], out=s[1:])
            h = h ^ (h >> np.uint64(29))  # another value of each word for the next hash
            out.append(s)
        return out

    def ranges(self, prefix: list[np.ndarray], which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = prefix[which]
        x = (s[end] - s[start]) * self.inverses[which][start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values the place of the least one, the last of equals, by doubling."""
    place, done = np.arange(len(values)), 1
    value = values
    while done < width:
        step = min(done, width - done)
        left, right = value[: len(value) - step], value[step:]
        later = right <= left
        value = np.where(later, right, left)
        place = np.where(later, place[step:], place[: len(place) - step])
        done += step
    return place


def anchors(roller: Roller, texts: list[list[bytes]], length: int, seed: int) -> tuple[np.ndarray, ...] | None:
    """Anchors that stand for windows of any of the texts: text, hash, two extension hashes, first window, last - first.

    All texts are hashed in one go; seeds that cross into the next text never win, windows that do are left out.
    """
    sizes = np.array([len(t) for t in texts])
    total = int(sizes.sum())
    if total < length:
        return None
    prefix = roller.prefix([w for t in texts for w in t])
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(total - seed + 1)
    h = roller.ranges(prefix, 0, at, at + seed)
    h[owner[at] != owner[at + seed - 1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    place = _least(h, length - seed + 1)  # by window
    inside = owner[: total - length + 1] == owner[length - 1 :]
    same = inside[1:] & inside[:-1] & (place[1:] == place[:-1])
    first = np.flatnonzero(inside & np.concatenate([[True], ~same]))
    last = np.flatnonzero(inside & np.concatenate([~same, [True]]))
    if not len(first):
        return None
    where = place[first]
    # the anchor's place in the extension and the number of windows belong to what must agree
    shape = ((where - first) * 64 + (last - first)).astype(np.uint64)
    one, two = ((roller.ranges(prefix, k, first, last + length) ^ shape) * np.uint64(0x9FB21C651E98DF25) for k in (1, 2))
    text = owner[first]
    return text, h[where].view(np.int64), one.view(np.int64), two.view(np.int64), (first - begin[text]).astype(np.int32), (last - first).astype(np.int32)


def _groups(texts: list[list[bytes]], most: int = 150_000) -> Iterator[range]:
    """Consecutive texts of about ``most`` words."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield range(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield range(at, len(texts))


def _batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` maps a record batch slice to lists of arrays."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for b in batches:
            for at in range(0, b.num_rows, 400):
                for cols in fn(roller, b.slice(at, 400)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return arrow_rows(df, run, schema)


def _emit_anchors(length: int, seed: int):
    def fn(roller: Roller, b: pa.RecordBatch):
        rows = b.column(0).to_numpy(zero_copy_only=False)
        keys = b.column(1).to_numpy(zero_copy_only=False)
        texts = [words_of(t) for t in b.column(2).to_pylist()]
        for part in _groups(texts):
            got = anchors(roller, [texts[i] for i in part], length, seed)
            if got is not None:
                text, h, e, f, lo, more = got
                yield [h, e, f, rows[text + part.start], keys[text + part.start], lo, more]

    return fn


def _emit_windows(length: int):
    """From (row, key, blob, wanted: array of (lo, more)): the hashes of the wanted extensions' windows."""

    def fn(roller: Roller, b: pa.RecordBatch):
        for row, key, blob, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            prefix = roller.prefix(words_of(unpack(blob)))
            w = np.concatenate([np.arange(x["lo"], x["lo"] + x["more"] + 1) for x in wanted])
            one, two = (roller.ranges(prefix, k, w, w + length).view(np.int64) for k in (1, 2))
            yield [np.full(len(w), row, np.int64), np.full(len(w), key, np.int64), w.astype(np.int32), one, two]

    return fn


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row, key, spans): per row with repeats, the starts of repeated windows as (lo, more). ``docs``: row, key, text."""
    found = materialize(_batches(docs.select("row", "key", "text"), _emit_anchors(length, seed), "h long, e long, f long, row long, key long, lo int, more int"))
    # counts are written before they are joined, so that both sides of a join are dealt anew and hot keys can be split
    again = materialize(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    first, found = found, materialize(found.join(again, "h", "left_semi"))
    discard(first)
    # one line for each different extension of each anchor: how often, and one place where
    exts = materialize(found.groupBy("h", "e", "f").agg(F.count("*").alias("n"), F.min(F.struct("row", "key", "lo", "more")).alias("at")))
    full = exts.filter("n > 1").select("h", "e", "f")
    whole = found.join(full, ["h", "e", "f"], "left_semi").select("row", "key", "lo", "more")
    # anchors with several extensions: windows of one place each
    several = materialize(exts.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h"))
    ask = exts.join(several, "h", "left_semi").select("at.row", "at.key", "at.lo", "at.more")
    wanted = ask.groupBy("row", "key").agg(F.collect_list(F.struct("lo", "more")).alias("wanted"))  # no longer than its text
    asked = packed(docs.select("row", "key", "text")).join(wanted, ["row", "key"]).select("row", "key", "blob", "wanted")
    windows = materialize(_batches(asked, _emit_windows(length), "row long, key long, start int, a long, b long"))
    twice = materialize(windows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"))
    part = windows.join(twice, ["a", "b"], "left_semi").select("row", "key", F.col("start").alias("lo"), F.lit(0).alias("more"))
    return whole.unionByName(part).groupBy("row", "key").agg(F.collect_list(F.struct("lo", "more")).alias("spans"))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` (row, key, text and more) with the text as ``blob``, compressed for the way through a shuffle."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                blobs = [z.compress((t or "").encode("utf-8", "replace")) for t in part.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(blobs, pa.binary())], names=[*others, "blob"])

    kinds = dict(docs.dtypes)
    return arrow_rows(docs.select(*others, "text"), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "blob binary"]))


def unpack(blob: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(blob).decode()


def cut_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256 and, if asked, the kept text."""
    rows = docs.select(*row_identity(docs), "doc_id", "text")
    spans = repeats(rows, length, seed)
    both = packed(rows).join(spans, ["row", "key"], "left").select("doc_id", "blob", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                out: list[list] = [[] for _ in names[1:]]
                for blob, marked in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = words_of(unpack(blob))
                    keep = np.ones(len(words), bool)
                    for s in marked or ():
                        keep[s["lo"] : s["lo"] + s["more"] + length] = False
                    kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]) if marked else b" ".join(words)
                    values = [len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()]
                    for o, v in zip(out, values, strict=False):
                        o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=False))], names=names)

    return arrow_rows(both, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
