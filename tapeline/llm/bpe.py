"""Byte-level BPE by a tokenization automaton.

The automaton reads token labels and accepts exactly the sequences that BPE yields. It starts as one state with a loop
for each byte; each merge (u, v) -> w, in rank order, is a gadget: arcs u go to a copy of their target without v, and an
arc w is added from every state with an arc u to where v led. So the state after a label depends on the label alone, and
a copy keeps its parent's arcs but some: v, and all labels made later whose left part lost its arc. Labels are numbered
by a tour of the tree of left parts, children in rank order, in which those are v and one range. The compiled table has,
per state, the ranges of numbers without an arc: its own and those of up to ``ROW`` states that it was copied from, in
order and merged, and the state where its row goes on. A step looks a label's number up in the row and its rest, and
remembers the answer.

A pre-split word is read byte by byte: a trie with failure links gives the labels that end at each place, and of these
exactly one continues the accepted path of its prefix. Walking the path back emits the arcs, ids; decoding emits the
bytes of each arc's label. Words repeat, so their results are kept in a table of bounded size.

The vocabulary file is a parameter; the driver reads it and broadcasts its merges (a few MB, fixed by the vocabulary).

What the file says is honoured or refused: byte-level BPE with the usual split or one given as a pattern, with or without
a prefix space; a normalizer, other pre-tokenizers, dropout, word affixes, byte fallback, ignored merges and special
tokens that strip their surroundings or match whole words only raise an error. Ids may be of any size.

Edge cases: null text counts as empty: no ids, empty decoded text. Special tokens are recognised in the text before it
is split, as the tokenizer file says. Repeated rows are encoded each; an empty table gives no rows; columns that are not
kept are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import regex
from pyspark.sql import DataFrame

from tapeline.llm.common import keeps_tables, map_rows

#: Fixed: the pre-split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 400_000
KEPT_ARCS = 250_000
ROW = 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _split_of(d: dict) -> tuple[str, bool]:
    """The file's pre-split pattern, and whether a space is put before a text. Settings that are not known raise an error."""

    def refuse(what: str) -> None:
        raise ValueError(f"this tokenizer file asks for {what}, which is not supported")

    model = d["model"]
    if model.get("type", "BPE") != "BPE":
        refuse(f"a model of type {model['type']}")
    for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"):
        if model.get(name):
            refuse(name)
    if d.get("normalizer"):
        refuse("a normalizer")
    if (d.get("decoder") or {"type": "ByteLevel"})["type"] != "ByteLevel":
        refuse("another decoder")
    for t in d.get("added_tokens") or []:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            refuse(f"the token {t['content']!r} with its surroundings")
    pre = d.get("pre_tokenizer") or {"type": "ByteLevel"}
    steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
    if steps[-1]["type"] != "ByteLevel" or len(steps) > 2:
        refuse("other pre-tokenizers")
    space = bool(steps[-1].get("add_prefix_space"))
    if len(steps) == 1:
        if not steps[0].get("use_regex", True):
            refuse("no split")
        return SPLIT, space
    first = steps[0]
    if first["type"] != "Split" or first.get("behavior") != "Isolated" or first.get("invert") or "Regex" not in first["pattern"] or steps[-1].get("use_regex", True):
        refuse("another split")
    return first["pattern"]["Regex"], space


class Automaton:
    def __init__(self, spec: str):
        d = json.loads(spec)
        pattern, self.space = _split_of(d)
        vocab, alphabet = d["model"]["vocab"], byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
        self.label = {i: s.encode() for s, i in self.special.items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in d["model"]["merges"]]
        self.state: dict[int, int] = {}  # by label: where its arcs lead; state 0 is the start
        for c in alphabet:
            if c in vocab:
                self.state[vocab[c]] = 0
                self.label[vocab[c]] = as_bytes(c)
        parts: dict[int, tuple[int, int, int]] = {}  # by label: its rank and parts
        for rank, (a, b) in enumerate(merges):
            w = vocab[a + b]
            if w in parts:
                raise ValueError(f"two merges make the token {a + b!r}, which is not supported")
            parts[w] = (rank, vocab[a], vocab[b])
            self.label[w] = as_bytes(a) + as_bytes(b)
        self.known: dict[int, bool] = {}
        self.base = 1 + max(self.label, default=0)
        self._compile(parts)
        self.digits = {i: str(i) for i in self.label}
        self._trie()
        special = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_split = regex.compile(f"({special})").split if special else None
        self.split = _whole(regex.compile(pattern))
        self.kept: dict[str, tuple[str, int, bytes]] = {}

    def _trie(self) -> None:
        self.go: list[dict[int, int]] = [{}]
        ends = {0: -1}
        for token in self.state:
            node = 0
            for byte in self.label[token]:
                nxt = self.go[node].get(byte)
                if nxt is None:
                    nxt = self.go[node][byte] = len(self.go)
                    self.go.append({})
                node = nxt
            ends[node] = token
        self.fail, self.out = [0] * len(self.go), [()] * len(self.go)
        queue = [0]
        for node in queue:
            own = ends.get(node, -1)
            self.out[node] = ((own, len(self.label[own])), *self.out[self.fail[node]]) if own >= 0 else self.out[self.fail[node]] if node else ()
            for byte, child in self.go[node].items():
                f = self.fail[node]
                while node and f and byte not in self.go[f]:
                    f = self.fail[f]
                self.fail[child] = self.go[f].get(byte, 0) if node else 0
                queue.append(child)

    def _compile(self, parts: dict[int, tuple[int, int, int]]) -> None:
        """The states and their rows of tour numbers without an arc, by one gadget after the other."""
        children: dict[int, list[tuple[int, int]]] = {}
        for label, (rank, left, _) in parts.items():
            children.setdefault(left, []).append((rank, label))
        self.tour: dict[int, int] = {}
        end: dict[int, int] = {}
        for root in self.state:
            todo = [(root, False)]
            while todo:
                label, done = todo.pop()
                if done:
                    end[label] = len(self.tour)
                    continue
                self.tour[label] = len(self.tour)
                todo.append((label, True))
                todo += [(child, False) for _, child in sorted(children.get(label, ()), reverse=True)]
        self.starts, self.lo, self.hi, self.rest = array("q", [0, 0]), array("q"), array("q"), array("q", [-1])
        since, own = [0], [()]  # by state: how many states its row covers, and their ranges
        for w, (rank, u, v) in parts.items():
            if u not in self.state or v not in self.state or not self.follows(self.state[u], v):
                continue  # the two never stand side by side, so this merge makes nothing
            p = self.state[u]
            later = [c for r, c in children.get(v, ()) if r >= rank]  # w itself is one if u is v
            first = self.tour[later[0]] if later else end[v]  # in rank order, so the later ones end v's range
            fresh = since[p] >= ROW
            ranges = sorted({(self.tour[v], self.tour[v] + 1), (first, end[v])} | set(() if fresh else own[p]))
            at = -1
            for lo, hi in ranges:
                if hi > max(lo, at):
                    self.lo.append(max(lo, at))
                    self.hi.append(hi)
                    at = hi
            self.starts.append(len(self.lo))
            self.rest.append(p if fresh else self.rest[p])
            since.append(1 if fresh else since[p] + 1)
            own.append(tuple(ranges))
            self.state[w] = self.state[v]
            self.state[u] = len(own) - 1
        self.known.clear()

    def follows(self, state: int, token: int) -> bool:
        """Whether the table has an arc ``token`` from ``state``."""
        key = state * self.base + token
        if (known := self.known.get(key)) is not None:
            return known
        number, s, ok = self.tour[token], state, True
        while s > 0:
            at = bisect_right(self.lo, number, self.starts[s], self.starts[s + 1]) - 1
            if at >= self.starts[s] and number < self.hi[at]:
                ok = False
                break
            s = self.rest[s]
        if len(self.known) >= KEPT_ARCS:
            self.known.clear()
        self.known[key] = ok
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        go, fail, out, states, follows, known, base = self.go, self.fail, self.out, self.state, self.follows, self.known, self.base
        last, node = [-1] * (len(word) + 1), 0
        path = [0] * (len(word) + 1)  # the automaton's state after each prefix
        for i, byte in enumerate(word, 1):
            while (nxt := go[node].get(byte)) is None and node:
                node = fail[node]
            node = nxt or 0
            for token, size in out[node]:
                state = path[i - size]
                ok = known.get(state * base + token)
                if ok if ok is not None else follows(state, token):
                    last[i], path[i] = token, states[token]
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= len(self.label[last[at]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.label[i] for i in ids])

    def word(self, word: str) -> tuple[str, int, bytes]:
        """The word's ids joined by commas, how many they are, and the bytes they decode to."""
        if (got := self.kept.get(word)) is None:
            ids = self.encode_word(word.encode("utf-8", "replace"))
            got = (",".join([self.digits[i] for i in ids]), len(ids), self.decode(ids))
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            if len(word) <= 100:
                self.kept[word] = got
        return got

    def pieces(self, text: str) -> list[tuple[str, int, bytes]]:
        kept, word = self.kept.get, self.word
        lead = " " if self.space else ""
        if self.special_split is None or not any(s in text for s in self.special):
            return [kept(w) or word(w) for w in self.split(lead + text if text and not text[0].isspace() else text)]
        out = []
        for part in self.special_split(text):
            if part in self.special:
                out.append((str(self.special[part]), 1, part.encode()))
            else:
                out += [word(w) for w in self.split(lead + part if part and not part[0].isspace() else part)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text or "") if ids for i in ids.split(",")]


def _whole(pattern: regex.Pattern) -> Callable[[str], list[str]]:
    """Matches and, where a pattern leaves some, what lies between them."""
    if pattern.pattern == SPLIT:  # covers every text
        return pattern.findall

    def split(text: str) -> list[str]:
        out, at = [], 0
        for m in pattern.finditer(text):
            out += [x for x in (text[at : m.start()], m[0]) if x]
            at = m.end()
        return [*out, text[at:]] if text[at:] else out

    return split


@lru_cache(maxsize=2)
def _ready(spec: str) -> Automaton:
    auto = Automaton(spec)
    gc.collect()
    gc.freeze()  # the tables live as long as the worker; collections need not walk them
    return auto


def _forget() -> None:
    if _ready.cache_info().currsize:
        _ready.cache_clear()
        gc.unfreeze()
        gc.collect()


keeps_tables(__name__, _forget)


def encode_documents(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: ``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and decoded text."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    keep = keep or ["doc_id"]

    def run(slices: Iterator[dict]) -> Iterator[list[tuple]]:
        auto = _ready(spec.value)
        for rows in slices:
            out = []
            for *kept, text in zip(*(rows[c] for c in [*keep, "text"]), strict=True):
                got = auto.pieces(text or "")
                said, sizes, labels = zip(*got, strict=True) if got else ((), (), ())
                ids = ",".join(said)
                decoded = b"".join(labels).decode("utf-8", "replace").encode("utf-8")
                row = (*kept, sum(sizes), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                out.append((*row, [int(i) for i in ids.split(",")] if ids else [], decoded.decode()) if with_ids else row)
            yield out

    kinds = dict(docs.dtypes)
    more = ["ids array<int>", "decoded string"] if with_ids else []
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *more])
    return map_rows(docs, [*keep, "text"], run, schema)
