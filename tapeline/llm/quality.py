"""Quality classification by an interpolated modified Kneser-Ney n-gram model.

Symbols are Unicode characters as they are, of every script; 0 stands before and after a text. N-grams have order 4. The
model is trained on trusted text: documents that ``labels`` marks as good and not toxic, copies included. A hash of the
text splits all documents into two halves, with a model each; a document is scored by the model of the other half, so no
text is judged by a model that has learned from it or its copies, and limits are never taken from such scores.

All counting and scoring is by joins that are sharded by n-gram; no model is gathered anywhere. Documents are first
written in chunks of about ``CHUNK`` characters, as a table bucketed by chunk, so that what belongs to a chunk finds its
texts without moving them again:

- trusted ids are joined with the documents' ids and sent to their chunks, which count their n-grams; the counts are
  summed over chunks before they are dealt out;
- each order is joined with its contexts' totals and with the next lower order's probabilities;
- every chunk asks once for each n-gram that it holds; these are joined with the orders' tables, backing off where an
  n-gram or its context has not been seen, and the answers return to the chunk, which gives each document's mean negative
  log-likelihood over its whole text.

A document is kept if that lies between two quantiles of the trusted documents of its language: noise is too surprising,
endless repetition too predictable. Languages with few of those take the quantiles of all.

Edge cases: null or empty text has no perplexity and is rejected; a null language is a language of its own; without
trusted documents there are no limits and all other texts are kept; repeated rows are scored each; null ids are never
trusted; rows of ``labels`` with nulls are not trusted; an empty table gives no rows; extra columns pass through
``filter_quality``, whatever they are called. Within a chunk, n-grams are matched by 64 bits of hash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.scratch import app_folder
from tapeline.llm.common import arrow_rows, make_room, materialize, release_memory, ship, shuffle_width

ORDER = 4
CHUNK = 32 << 20
AT_ONCE = 1 << 20  # characters of a chunk that are numbered together
MERGE_AT = 1 << 20  # n-grams of such parts that wait to be merged
DENSE = 1 << 24
LOW, HIGH = 0.003, 0.99
LEAST_TRUSTED = 50
MOST_LANGUAGES = 10_000
GRAM = [f"w{k}" for k in range(1, ORDER + 1)]
HALF = "h"  # of the model
COLUMNS = ", ".join(f"{c} int" for c in (HALF, *GRAM))


def number(values: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the place of each value among them. By a table where the space is small."""
    if space > DENSE:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(space, bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    place = np.empty(space, np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[values]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (n, ORDER), the number of each place's n-gram, and where each text's places begin.

    A text has an n-gram ending at each of its characters and at its end.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pad = np.full(ORDER - 1, 0, np.int64)
    begin = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    line = np.zeros(int(sizes.sum()) + ORDER * len(texts), np.int64)
    line[np.arange(len(points)) + np.repeat(begin + len(pad) - (np.cumsum(sizes) - sizes), sizes)] = points
    symbols, s = number(line, 0x110000)
    pairs, p = number(s[:-1].astype(np.int64) * len(symbols) + s[1:], len(symbols) ** 2)
    at = np.arange(int(sizes.sum()) + len(texts)) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), sizes + 1)  # the last place of each n-gram
    grams, place = number(p[at - 3].astype(np.int64) * len(pairs) + p[at - 1], len(pairs) ** 2)
    first, last = pairs[grams // len(pairs)], pairs[grams % len(pairs)]
    found = np.stack([symbols[first // len(symbols)], symbols[first % len(symbols)], symbols[last // len(symbols)], symbols[last % len(symbols)]], 1)
    return found.astype(np.int32), place, np.cumsum(sizes + 1) - (sizes + 1)


def _names(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64) + np.uint64(1)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _groups(texts: list[str]) -> Iterator[slice]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + ORDER
        if held >= AT_ONCE:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    every, c = np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.lexsort(every.T[::-1])
    every, c = every[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]).any(1)]))
    return every[new], np.add.reduceat(c, new)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and how often each occurs."""
    parts, waiting = [], 0
    for g in _groups(texts):
        found, place, _ = grams_of(texts[g])
        parts.append((found, np.bincount(place, minlength=len(found))))
        waiting += len(found)
        if waiting > max(MERGE_AT, 2 * len(parts[0][0])):
            parts, waiting = [_merged(parts)], 0
    if not parts:
        return np.zeros((0, ORDER), np.int32), np.zeros(0, np.int64)
    return _merged(parts)


def trusted(labels: DataFrame) -> DataFrame:
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()


def half_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & 1


class Chunks:
    """A table that is bucketed by ``_chunk``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def read(self, *columns: str) -> DataFrame:
        return self.spark.table(self.name).select(*columns) if columns else self.spark.table(self.name)


def chunked(docs: DataFrame) -> Chunks:
    """``docs`` with ``_chunk``, written as a table that is bucketed by it; a task closes a chunk when it is full."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            sizes = np.array([0 if n is None else n for n in pa.compute.utf8_length(b.column(at)).to_pylist()], np.int64)
            full = (held + np.cumsum(sizes + ORDER)) // CHUNK
            held = int((held + (sizes + ORDER).sum()) % CHUNK) if b.num_rows else held
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk + full, pa.int64())], names=[*b.schema.names, "_chunk"])
            chunk += int(full[-1]) if b.num_rows else 0

    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    out = arrow_rows(docs, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in docs.columns), "_chunk long"]))
    name = f"tapeline_{uuid.uuid4().hex}"
    out.write.format("parquet").option("path", f"{app_folder(spark)}/{name}").option("compression", "zstd").bucketBy(shuffle_width(spark), "_chunk").saveAsTable(name)
    return Chunks(spark, name)


def _beside(chunks: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` (documents, rows of ``right``) for each chunk; only ``right`` is dealt out."""
    ship(chunks.sparkSession)

    def run(key, docs, rows):
        make_room(fn.__module__)
        out = fn(docs, rows)
        release_memory()
        return out

    return chunks.groupBy("_chunk").cogroup(right.groupBy("_chunk")).applyInArrow(run, schema)


def _by_half(texts: list[str], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each model: its number at each row, the distinct n-grams of the texts of its own or of the other half, their counts."""
    halves = [half_of(t) for t in texts]
    for h in (0, 1):
        grams, c = _counted([t for t, x in zip(texts, halves, strict=True) if (x == h) == own])
        yield np.full(len(grams), h, np.int32), grams, c.astype(np.int64)


def count_grams(chunks: Chunks, labels: DataFrame) -> DataFrame:
    """(h, w1 to w4, c): occurrences in the trusted texts of each half."""
    known = materialize(chunks.read("_chunk", "doc_id").join(trusted(labels), "doc_id").distinct())  # small, and a frame of its own beside the texts

    def count(docs: pa.Table, ids: pa.Table) -> pa.Table:
        mine = set(ids["doc_id"].to_pylist())
        texts = [t for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True) if i in mine and t] if mine else []
        h, grams, c = (np.concatenate(x) for x in zip(*_by_half(texts, True), strict=True))
        return pa.table({HALF: pa.array(h), **{w: pa.array(grams[:, k]) for k, w in enumerate(GRAM)}, "c": pa.array(c)})

    counts = _beside(chunks.read("_chunk", "doc_id", "text"), known, count, COLUMNS + ", c long")
    return counts.groupBy(HALF, *GRAM).agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """By model: modified Kneser-Ney discounts of counts 1, 2 and more, from the counts of counts."""
    found = counts.groupBy(HALF).agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()
    out = {0: [0.5, 0.75, 0.9], 1: [0.5, 0.75, 0.9]}
    for h, n1, n2, n3, n4 in found:
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            out[h] = [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]
    return out


def _of(values: dict[int, float]) -> Column:
    return F.when(F.col(HALF) == 0, float(values.get(0, 1.0))).otherwise(float(values.get(1, 1.0)))


class Model:
    """Tables per order k: ``p`` (h, its n-grams' last k symbols, p) and ``weight`` (h, their contexts, weight of the lower order)."""

    def __init__(self, counts: DataFrame):
        c = {ORDER: materialize(counts)}
        for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter n-gram
            c[k] = materialize(c[k + 1].groupBy(HALF, *GRAM[ORDER - k :]).agg(F.count("*").alias("c")))
        # one symbol more, for all that were never seen
        self.uniform = {0: 1.0, 1: 1.0} | {r[HALF]: 1.0 / (r["n"] + 1) for r in c[1].groupBy(HALF).agg(F.count("*").alias("n")).collect()}
        self.p: dict[int, DataFrame] = {}
        self.weight: dict[int, DataFrame] = {}
        for k in range(1, ORDER + 1):
            d = _discounts(c[k])
            own, context = [HALF, *GRAM[ORDER - k :]], [HALF, *GRAM[ORDER - k : -1]]
            cut = F.when(F.col("c") == 1, _of({h: x[0] for h, x in d.items()})).when(F.col("c") == 2, _of({h: x[1] for h, x in d.items()})).otherwise(_of({h: x[2] for h, x in d.items()}))
            rows = c[k].withColumn("d", cut)
            totals = rows.groupBy(*context).agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
            self.weight[k] = materialize(totals.select(*context, (F.col("mass") / F.col("total")).alias("weight")))
            rows = rows.join(totals, context)
            rows = rows.withColumn("lower", _of(self.uniform)) if k == 1 else rows.join(self.p[k - 1].withColumnRenamed("p", "lower"), [HALF, *GRAM[ORDER - k + 1 :]])
            self.p[k] = materialize(rows.select(*own, ((F.col("c") - F.col("d") + F.col("mass") * F.col("lower")) / F.col("total")).alias("p")))

    def surprise(self, grams: DataFrame) -> DataFrame:
        """``grams`` (h, w1 to w4) with nll: what was not seen takes its context's weight times the lower order."""
        found, p = grams, None
        for k in range(1, ORDER + 1):
            found = found.join(self.p[k].withColumnRenamed("p", f"p{k}"), [HALF, *GRAM[ORDER - k :]], "left")
            found = found.join(self.weight[k].withColumnRenamed("weight", f"g{k}"), [HALF, *GRAM[ORDER - k : -1]], "left")
            p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"g{k}"), F.lit(1.0)) * (_of(self.uniform) if p is None else p))
        return found.select(HALF, *GRAM, (-F.log(F.greatest(p, F.lit(1e-12)))).cast("float").alias("nll"))


def score(chunks: Chunks, model: Model) -> DataFrame:
    """The documents' columns, n_grams and nll (mean per n-gram of the whole text; null without text)."""
    names = [c for c in chunks.read().columns if c != "_chunk"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(chunk: int, texts: list[str]) -> Iterator[pa.RecordBatch]:
            for h, grams, _ in _by_half(texts, False):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), chunk, np.int64)), pa.array(h), *(pa.array(grams[:, k]) for k in range(ORDER))], names=["_chunk", HALF, *GRAM])

        chunk, texts = None, []
        for b in batches:
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c != chunk and texts:
                    yield from told(chunk, texts)
                    texts = []
                chunk = c
                if t:
                    texts.append(t)
        if texts:
            yield from told(chunk, texts)

    asked = materialize(arrow_rows(chunks.read("_chunk", "text"), ask, "_chunk long, " + COLUMNS))
    # a chunk that was read in two parts may ask twice: its answers are the same
    answers = asked.join(model.surprise(asked.select(HALF, *GRAM).distinct()), [HALF, *GRAM]).select("_chunk", HALF, *GRAM, "nll")

    def answer(docs: pa.Table, rows: pa.Table) -> pa.Table:
        docs = docs.select(names)
        n, nll = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows)
        every, model_of = np.stack([rows[w].to_numpy() for w in GRAM], 1), rows[HALF].to_numpy()
        known = []
        for h in (0, 1):
            mine = model_of == h
            name, value = _names(every[mine]), rows["nll"].to_numpy()[mine].astype(np.float64)
            order = np.argsort(name, kind="stable")
            known.append((name[order], value[order]))
        del every, model_of

        def judge(h: int, at: list[int], texts: list[str]) -> None:
            name, value = known[h]
            grams, place, begin = grams_of(texts)
            each = value[np.searchsorted(name, _names(grams))][place]
            n[at] = np.diff([*begin, len(place)])
            nll[at] = np.add.reduceat(each, begin) / n[at]

        # only some texts at a time are held as strings
        at: tuple[list[int], list[int]] = ([], [])
        texts: tuple[list[str], list[str]] = ([], [])
        held = [0, 0]
        for i, scalar in enumerate(docs["text"]):
            if t := scalar.as_py():
                h = 1 - half_of(t)
                at[h].append(i)
                texts[h].append(t)
                held[h] += len(t) + ORDER
                if held[h] >= AT_ONCE:
                    judge(h, at[h], texts[h])
                    at[h].clear()
                    texts[h].clear()
                    held[h] = 0
        for h in (0, 1):
            if texts[h]:
                judge(h, at[h], texts[h])
        return docs.append_column("n_grams", pa.array(n)).append_column("nll", pa.array(nll, pa.float64(), mask=n == 0))

    kinds = dict(chunks.read().dtypes)
    return _beside(chunks.read("_chunk", *names), answers, answer, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_grams long, nll double"]))


def limits(scored: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    """Per language: the quantiles of its trusted documents; all languages' ones are in the row with ``everyone``."""
    good = scored.filter(F.col("nll").isNotNull()).join(trusted(labels), "doc_id", "left_semi")
    q = F.percentile_approx("nll", F.array(F.lit(low), F.lit(high)), F.lit(20_000)).alias("q")
    own = good.groupBy("lang").agg(q, F.count("*").alias("n")).filter(F.col("n") >= LEAST_TRUSTED).select("lang", F.lit(False).alias("everyone"), "q")
    return own.unionByName(good.agg(q).select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("everyone"), "q"))


def _judge(scored: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ppl_low, ppl_high and keep. The limits are a row per language; sent whole only if that is few."""
    rows = found.limit(MOST_LANGUAGES + 1).collect()
    spark = scored.sparkSession
    every = next((r["q"] for r in rows if r["everyone"]), None) or [None, None]
    if len(rows) <= MOST_LANGUAGES:
        small = [(r["lang"], float(r["q"][0]), float(r["q"][1])) for r in rows if not r["everyone"]]
        own = F.broadcast(spark.createDataFrame(small, "_lang string, _lo double, _hi double"))
    else:
        own = found.filter(~F.col("everyone")).select(F.col("lang").alias("_lang"), F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    lo, hi = (F.coalesce(F.col(c), F.lit(v).cast("double")) for c, v in (("_lo", every[0]), ("_hi", every[1])))
    keep = F.col("nll").isNotNull() & F.coalesce(F.col("nll").between(lo, hi), F.lit(True))
    return out.withColumns({"ppl_low": F.exp(lo), "ppl_high": F.exp(hi), "keep": keep}).drop("_lang", "_lo", "_hi")


def _judged(docs: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    """``docs`` (doc_id, lang, text and columns with names of their own) with n_grams, nll, ppl_low, ppl_high, keep."""
    chunks = chunked(docs)
    scored = materialize(score(chunks, Model(count_grams(chunks, labels))))
    return _judge(scored, limits(scored, labels, low, high))


def quality_report(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per document: doc_id, lang, n_grams, perplexity, ppl_low, ppl_high, keep."""
    chunks = chunked(docs.select("doc_id", "lang", "text"))
    scored = materialize(score(chunks, Model(count_grams(chunks, labels))).drop("text"))
    return _judge(scored, limits(scored, labels, low, high)).select("doc_id", "lang", "n_grams", F.exp("nll").alias("perplexity"), "ppl_low", "ppl_high", "keep")


def filter_quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    needed = {"doc_id", "lang", "text"}
    names = [c if c in needed else f"_c{i}" for i, c in enumerate(docs.columns)]  # whatever they are called, the columns made here don't clash
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    kept = _judged(inner, labels, low, high).filter("keep")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
