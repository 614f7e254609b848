"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter keeps its maximum in the window, and a
softmax layer turns the maxima into language probabilities. The network is trained in numpy on windows of a bounded
sample of labelled documents (``PER_LANGUAGE`` texts of each language, ``MOST_TEXTS`` in all, chosen by a hash of the
text; ``PIECES`` windows each, out of at most ``PART`` characters). For use, a filter of width w is folded into tables over byte pairs, so a window costs a few table
look-ups per byte. Every window of a whole text counts; their probabilities are averaged by bytes.

Edge cases: null, empty or letterless text gives ``und`` with score 0; texts shorter than a window are padded with zero
bytes, as in training; documents with a null language are not learned from; with nothing to learn from, all is ``und``.
Ties between languages go to the first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.llm.common import map_rows

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 400
MOST_TEXTS = 20_000  # of all languages, for training
PART = 4000  # characters of a text, for training
PIECES = 6
STEPS = 500
BATCH = 96
UNKNOWN = "und"
BLOCK = 256  # windows that are convolved at once

_LETTER = regex.compile(r"\p{L}").search


@dataclass
class Network:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    weights: np.ndarray  # (widths * FILTERS, languages)
    bias: np.ndarray

    def pair_tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width, tables over 256 * byte + next byte; a filter's response is the sum over (offset, table)."""
        out = {}
        for width, f in self.filters.items():
            tables = []
            for at in range(0, width, 2):
                second = f[at + 1] if at + 1 < width else np.zeros_like(f[at])
                tables.append((at, (f[at][:, None, :] + second[None, :, :]).reshape(65536, -1).astype(np.float32)))
            out[width] = tables
        return out


def _windows(text: str, rng: np.random.Generator, pieces: int) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    out = []
    for _ in range(pieces):
        size = WINDOW if rng.random() < 0.7 else int(rng.integers(16, WINDOW))
        at = int(rng.integers(0, max(1, len(raw) - size + 1)))
        out.append(raw[at : at + size])
    return out


def train(samples: list[tuple[str, str]], seed: int = 7, steps: int = STEPS) -> Network:
    """Adam on the cross entropy of windows; only the winning place of each filter gets a gradient."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    filters = {w: rng.normal(0, 0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    weights = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(languages)))).astype(np.float32)
    bias = np.zeros(max(1, len(languages)), np.float32)
    net = Network(languages, filters, weights, bias)
    if len(languages) < 2:
        return net
    data = np.zeros((len(samples) * PIECES, WINDOW), np.uint8)
    labels = np.zeros(len(data), np.int64)
    for i, (text, lang) in enumerate(samples):
        for j, piece in enumerate(_windows(text, rng, PIECES)):
            data[i * PIECES + j, : len(piece)] = np.frombuffer(piece, np.uint8)
            labels[i * PIECES + j] = languages.index(lang)
    by_label = [np.flatnonzero(labels == k) for k in range(len(languages))]
    params = [*filters.values(), weights, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(ix, BATCH // len(languages) + 1) for ix in by_label])
        x, y = data[pick], labels[pick]
        maxima, places = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = sum(filters[w][k][x[:, k : k + n]] for k in range(w))
            at = z.argmax(1)
            places.append(at)
            maxima.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
        m = np.concatenate(maxima, 1)
        h = np.tanh(m)
        logits = h @ weights + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ weights.T) * (1 - h * h)
        grads = []
        for i, w in enumerate(WIDTHS):
            g = np.zeros_like(filters[w])
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(w):
                byte = np.take_along_axis(x, places[i] + k, 1)
                np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), d)
            grads.append(g)
        grads += [h.T @ p, p.sum(0)]
        for q, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= (0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def window_probabilities(net: Network, tables: dict, flat: np.ndarray) -> np.ndarray:
    """``flat``: bytes of whole windows, one after the other."""
    windows = flat.reshape(-1, WINDOW)
    out = np.empty((len(windows), len(net.languages)), np.float32)
    for at in range(0, len(windows), BLOCK):
        x = np.ascontiguousarray(windows[at : at + BLOCK].T).astype(np.int32)  # (place, window)
        pairs = np.zeros_like(x)
        pairs[:-1] = x[:-1] * 256 + x[1:]
        pairs[-1] = x[-1] * 256
        maxima = []
        for width in WIDTHS:
            n = WINDOW - width + 1
            z = None
            for k, t in tables[width]:
                part = t.take(pairs[k : k + n], axis=0)
                z = part if z is None else np.add(z, part, out=z)
            maxima.append(z.max(0))
        logits = np.tanh(np.concatenate(maxima, 1)) @ net.weights + net.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        out[at : at + BLOCK] = p / p.sum(1, keepdims=True)
    return out


def predict(net: Network, tables: dict, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each whole text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if not net.languages:
        return out
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        sizes = np.array([-(-len(raw) // WINDOW) for _, raw in group])
        flat = np.zeros(int(sizes.sum()) * WINDOW, np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        weight = np.full(int(sizes.sum()), WINDOW, np.float32)
        for (_, raw), s, n in zip(group, starts, sizes, strict=True):
            flat[s * WINDOW : s * WINDOW + len(raw)] = np.frombuffer(raw, np.uint8)
            weight[s + n - 1] = len(raw) - (n - 1) * WINDOW
        p = window_probabilities(net, tables, flat) * weight[:, None]
        for i, (row, raw) in enumerate(group):
            mean = p[starts[i] : starts[i] + sizes[i]].sum(0) / len(raw)
            best = int(mean.argmax())
            out[row] = (net.languages[best], float(min(1.0, max(0.0, mean[best]))))
        group, held = [], 0

    for row, text in enumerate(texts):
        if text and _LETTER(text):
            raw = text.encode("utf-8", "replace")
            group.append((row, raw))
            held += len(raw)
            if held > 4 << 20:
                flush()
    flush()
    return out


def held_out_column() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most_texts: int = MOST_TEXTS, part: int = PART) -> list[tuple[str, str]]:
    """The ``per_language`` distinct labelled texts of each language that a hash puts first, each as (part, language).

    Copies count once. Where languages are so many that this would be more than ``most_texts``, every language gives its
    first texts before any gives further ones. Of a text over ``part`` characters, that many from a place set by its hash
    are taken, as it gives PIECES windows only. Rows and order depend on the texts alone.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    named = labelled.select("lang", "text", F.xxhash64("text", F.lit(1)).alias("h"))
    # only hashes are dealt out, and each task passes on no more than per_language of a language
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ranked = named.select("lang", "h").distinct().withColumn("rank", first).filter(F.col("rank") <= per_language)
    drawn = ranked.orderBy("rank", "h", "lang").limit(most_texts).select("lang", "h").collect()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(drawn, "lang string, h long"))  # most_texts rows at most
    place = F.pmod(F.xxhash64("text", F.lit(2)), F.greatest(F.lit(1), F.length("text") - part)).cast("int") + 1
    rows = named.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.col("text").substr(place, F.lit(part))).alias("part"))
    return sorted((r["part"], r["lang"]) for r in rows.collect())


def identify(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """Per row: ``keep`` columns, lang_pred and score; only the text is looked at."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(slices: Iterator[dict]) -> Iterator[list[tuple]]:
        ready = sent.value
        tables = ready.pair_tables()
        for rows in slices:
            yield [(*kept, *said) for *kept, said in zip(*(rows[c] for c in keep), predict(ready, tables, rows["text"]), strict=True)]

    kinds = dict(docs.dtypes)
    return map_rows(docs, [*keep, "text"], run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))


def language_report(docs: DataFrame) -> DataFrame:
    net = train(training_sample(docs.filter(~held_out_column())))
    return identify(docs, net).select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")
