"""Format-preserving Feistel pseudonyms for personal numbers, dates, addresses and keys.

What is found is first validated (card numbers by Luhn, IBANs by mod 97, IP octets, calendar dates, area codes), so
other numbers stay. Keys are known by their prefix, or by a name such as ``token`` before ``=`` or ``:``, in any case,
with or without blanks and quotes. A validated value's variable part is read as a number below some limit and permuted
there by a keyed balanced Feistel network with cycle walking; check digits are made anew, separators, prefixes and case
stay. The same value gives the same pseudonym in every document, whatever its separators, and with the key the
permutation can be undone. Phone numbers keep their country code, which the fixed prefixes of the numbering plan tell,
so a number is the same with or without separators, a bracketed trunk zero or, in North America, the code itself.

A calendar day has one pseudonym however it is written. So that every writing keeps its widths and is read back in its
own order, a day stays in its class: day of the month below 10, below 13 or above, month below 10 or not. Those two
facts of a date therefore remain visible; years are permuted over 1900 to 2099.

The key is the caller's. ``secret_key`` takes it from the session's setting ``spark.tapeline.pseudonym.key``; where that
is not set, an application draws a key of its own, so values are linked within its results and nobody can undo them.

Edge cases: null text stays null; empty text and text without such values stay as they are; a value that is
part of a longer word or number is not one; where tokens after a value would fit its pattern, the usual length of a card
or IBAN is tried first and then shorter ends from the longest, so digits that can be read in two ways next to a value may
not be restored exactly; repeated rows give equal results; ``n_found`` is 0 for null text; an empty key is an error; an
empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from tapeline.llm.common import map_rows

KEY_SETTING = "spark.tapeline.pseudonym.key"
ROUNDS = 8
#: Country calling codes of one and two digits; all others have three.
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
# a key's name and what stands between it and the value
_NAMED = r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ \t]{0,8}(?:=>|:=|[=:])[ \t]{0,8}"
# up to the closing quote, or a word without the marks that end it
_KEY_VALUE = rf"(?<={_NAMED}\")[^\"\n]{{6,128}}(?=\")|(?<={_NAMED}')[^'\n]{{6,128}}(?=')|(?<={_NAMED}[\"']?)[^\s\"'<>]{{5,}}[^\s\"'<>.,;:!?)\]}}]"
_HEX = regex.compile(r"(?=\d*[a-fA-F])(?:[0-9a-f]{32,}|[0-9A-F]{32,})").fullmatch
_TOKEN = regex.compile(r"[^\W_]+|[\W_]+[^\W_]*").match
_GAP = regex.compile(r"(?<=[^\W_])[\W_]+").finditer
_GOES_ON = regex.compile(r"\w|-\d").match
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def secret_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, or one that this application draws once and keeps."""
    if said := spark.conf.get(KEY_SETTING, ""):
        return said.encode()
    sc = spark.sparkContext
    if not getattr(sc, "_tapeline_key", None):
        sc._tapeline_key = secrets.token_bytes(32)
    return sc._tapeline_key


def country_code(digits: str) -> str:
    return digits[:1] if digits[:1] in _ONE_DIGIT else digits[:2] if digits[:2] in _TWO_DIGITS else digits[:3]


@lru_cache(maxsize=1)
def _day_classes() -> tuple[dict[int, tuple[int, int]], list[list[dt.date]]]:
    """Place (class, number) of each day, and the days of each class."""
    groups: dict[tuple[int, bool], list[dt.date]] = {}
    for n in range(_DAYS):
        d = dt.date.fromordinal(_DAY0 + n)
        groups.setdefault((0 if d.day < 10 else 1 if d.day < 13 else 2, d.month < 10), []).append(d)
    lists = [groups[k] for k in sorted(groups)]
    return {d.toordinal(): (i, n) for i, days in enumerate(lists) for n, d in enumerate(days)}, lists


class Feistel:
    """Keyed permutation of the numbers below a limit, one for each (kind, limit)."""

    def __init__(self, key: bytes):
        self.key = key
        self.pad = lru_cache(maxsize=100_000)(self._pad)

    def _pad(self, kind: str, limit: int, turn: int, half: int) -> int:
        said = f"{kind}|{limit}|{turn}|{half}".encode()
        return int.from_bytes(hmac.new(self.key, said, hashlib.sha256).digest(), "big")

    def _walk(self, kind: str, limit: int, value: int, turns: range, sign: int) -> int:
        if limit < 2:
            return value
        side = math.isqrt(limit - 1) + 1  # two digits of base ``side`` hold every value
        while True:
            a, b = divmod(value, side)
            for turn in turns:
                if sign > 0:
                    a, b = b, (a + self.pad(kind, limit, turn, b)) % side
                else:
                    a, b = (b - self.pad(kind, limit, turn, a)) % side, a
            value = a * side + b
            if value < limit:
                return value

    def permute(self, kind: str, limit: int, value: int) -> int:
        return self._walk(kind, limit, value, range(ROUNDS), 1)

    def invert(self, kind: str, limit: int, value: int) -> int:
        return self._walk(kind, limit, value, range(ROUNDS - 1, -1, -1), -1)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


class Pseudonyms:
    """Finds and replaces. ``sign`` 1 hides, -1 restores."""

    def __init__(self, key: bytes, sign: int = 1):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.f = Feistel(key)
        self.turn = self.f.permute if sign > 0 else self.f.invert
        kinds: list[tuple[str, str, Callable[[str], str | None]]] = [
            ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", self.email),
            ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", self.iban),
            ("secret", r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:ghp_|gho_|sk-|sk_live_|xox[abp]-)[A-Za-z0-9]{16,}(?!\w)|" + _KEY_VALUE, self.secret),
            ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", self.ip),
            ("date", r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w]|[-/.]\d)", self.date),
            ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", self.ssn),
            ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])", self.phone),
            ("card", r"(?<![\w.,-])\d(?:[ -]?\d){12,18}(?![\w]|[-]\d)", self.card),
        ]
        self.makers = {name: fn for name, _, fn in kinds}
        # the kinds' own groups (separators of dates) get names, so that they can be combined
        whole = "|".join(f"(?P<{name}>{p})" for name, p, _ in kinds).replace("([-/.])\\d{1,2}\\1", "(?P<s1>[-/.])\\d{1,2}(?P=s1)").replace("([-/.])\\d{1,2}\\2", "(?P<s2>[-/.])\\d{1,2}(?P=s2)")
        self.find = regex.compile(whole)
        self.alone = {name: regex.compile(p) for name, p, _ in kinds}
        self.maybe = regex.compile(r"\d|@|(?i:password|passwd|secret|token|api[_-]?key)|(?:sk-|ghp_|gho_|sk_live_|xox[abp]-)").search

    # -- parts ------------------------------------------------------------------------------------------------------
    def _digits(self, kind: str, digits: str) -> str:
        return str(self.turn(kind, 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else digits

    def _refill(self, template: str, chars: str) -> str:
        """``chars`` in the places of the digits of ``template``."""
        it = iter(chars)
        return "".join(next(it) if c.isdigit() else c for c in template)

    def _text(self, kind: str, s: str) -> str:
        """Letters stay letters of their case, digits digits; the rest stays in its place."""
        sizes = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in s]
        value = 0
        for c, n in zip(s, sizes, strict=True):
            if n > 1:
                value = value * n + (int(c) if n == 10 else ord(c.lower()) - 97)
        value = self.turn(f"{kind}{''.join('d' if n == 10 else 'a' if n == 26 else '.' for n in sizes)}", math.prod(sizes), value)
        out = []
        for c, n in zip(reversed(s), reversed(sizes), strict=True):
            if n == 1:
                out.append(c)
                continue
            value, d = divmod(value, n)
            out.append(str(d) if n == 10 else chr(d + (65 if c.isupper() else 97)))
        return "".join(reversed(out))

    # -- kinds: the pseudonym, or None if the value isn't valid -------------------------------------------------------
    def email(self, s: str) -> str:
        local, _, domain = s.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{self._text('mail', local)}@{self._text('host', host)}.{top}"

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _iban_number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = self._text("iban", flat[4:])
        check = f"{98 - _iban_number(body + flat[:2] + '00') % 97:02d}"
        it = iter(flat[:2] + check + body)
        return "".join(c if c == " " else next(it) for c in s)

    def secret(self, s: str) -> str:
        head = next((p for p in ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk-", "xoxa-", "xoxb-", "xoxp-") if s.startswith(p)), "")
        body = s[len(head) :]
        hexadecimal = bool(_HEX(body))
        while True:  # cycle walking among the values of the same format
            body = self._hex(body, s.upper() == s) if hexadecimal else self._text("secret", body)
            if bool(_HEX(body)) == hexadecimal:
                return head + body

    def _hex(self, s: str, upper: bool) -> str:
        new = f"{self.turn('hex', 16 ** len(s), int(s, 16)):0{len(s)}x}"
        return new.upper() if upper else new

    def ip(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255:
            return None
        value = self.turn("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(str(b) for b in value.to_bytes(4, "big"))

    def date(self, s: str) -> str | None:
        sep = next(c for c in s if not c.isdigit())
        parts = s.split(sep)
        iso = len(parts[0]) == 4
        first, second, year = (parts[2], parts[1], parts[0]) if iso else parts
        # day before month, unless only the other order gives a date; a pseudonym keeps to the same side of the 12th
        month_first = not iso and sep == "/" and int(second) > 12 >= int(first)
        day, month = (second, first) if month_first else (first, second)
        try:
            n = dt.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        places, lists = _day_classes()
        if n not in places:
            return None
        kind, at = places[n]
        new = lists[kind][self.turn(f"date{kind}", len(lists[kind]), at)]
        day, month = str(new.day).zfill(len(day)), str(new.month).zfill(len(month))
        return sep.join([f"{new.year:04d}", month, day] if iso else [month, day, f"{new.year:04d}"] if month_first else [day, month, f"{new.year:04d}"])

    def ssn(self, s: str) -> str | None:
        area, group, serial = s.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        value = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
        value = self.turn("ssn", len(areas) * 99 * 9999, value)
        value, serial_n = divmod(value, 9999)
        area_n, group_n = divmod(value, 99)
        return f"{areas[area_n]:03d}-{group_n + 1:02d}-{serial_n + 1:04d}"

    def phone(self, s: str) -> str | None:
        trunk = s.find("(0)") if s.startswith("+") else -1  # said beside the country code, it is no part of the number
        head, tail = (s[:trunk], s[trunk:]) if trunk >= 0 else (s, "")
        said, tail = ("(0)", tail[3:]) if trunk >= 0 else ("", "")
        digits = "".join(c for c in head + tail if c.isdigit())
        if not 8 <= len(digits) <= 15:
            return None
        code = country_code(digits) if s.startswith("+") else ""
        own = digits[len(code) :]
        if code and len(own) < 6:
            return None
        filled = self._refill(head + tail, code + self._digits("phone", own))
        return filled[: len(head)] + said + filled[len(head) :]

    def card(self, s: str) -> str | None:
        digits = "".join(c for c in s if c.isdigit())
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = digits[:1] + self._digits("card", digits[1:-1])
        return self._refill(s, body + luhn_digit(body))

    def replace(self, text: str) -> tuple[str, int]:
        if not self.maybe(text):
            return text, 0
        out, found, done, at = [], 0, 0, 0
        while m := self.find.search(text, at):
            start, name = m.start(), m.lastgroup if m.lastgroup in self.makers else "date"
            new, end = self._valid(text, start, m.end(), name)
            if new is None:  # a value may begin at the next token
                at = _TOKEN(text, start).end()
                continue
            out += text[done:start], new
            found, done, at = found + 1, end, end
        return "".join([*out, text[done:]]), found

    def _valid(self, text: str, start: int, end: int, name: str) -> tuple[str | None, int]:
        """Pseudonym and end of the value at ``start``: as far as it was found, or without its last tokens, or of a later kind."""
        names = list(self.makers)
        for kind in names[names.index(name) :]:
            if kind != name:
                m = self.alone[kind].match(text, start)
                if not m:
                    continue
                end = m.end()
            ends = [end, *(start + m.start() for m in reversed(list(_GAP(text[start:end]))))]
            if kind == "phone":  # digits that are no number of a phone may be those of a card
                card = self.alone["card"].search(text, _TOKEN(text, start).end())
                if self.phone(text[start:end]) is None and card and card.start() < end and self._valid(text, card.start(), card.end(), "card")[0]:
                    return None, end
            usual = self._usual(kind, text[start:end])
            for e in sorted(ends, key=lambda e: sum(map(str.isalnum, text[start:e])) != usual):
                if e == end or self.alone[kind].fullmatch(text, start, e) and not _GOES_ON(text, e):
                    new = self.makers[kind](text[start:e])
                    if new is not None:
                        return new, e
        return None, end

    def _usual(self, kind: str, s: str) -> int:
        """The length that is tried first, which the pseudonym shows as well; 0 where there is none."""
        if kind == "iban":
            return _IBAN_LENGTH.get(s[:2], 0)
        return (15 if s[0] == "3" else 16) if kind == "card" else 0


def pseudonymize(docs: DataFrame, key: bytes, keep: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` (or ``keep``), ``text`` with pseudonyms, and ``n_found`` unless one of them is called so."""
    if not key:
        raise ValueError("pseudonyms need a key")
    keep = keep or docs.columns
    names = [f"_c{i}" for i in range(len(keep))]
    inner = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(keep, names, strict=True)])
    at = keep.index("text")

    def run(slices: Iterator[dict]) -> Iterator[list[tuple]]:
        p = Pseudonyms(key)
        for rows in slices:
            out = []
            for row in zip(*(rows[n] for n in names), strict=True):
                new, found = p.replace(row[at]) if row[at] else (row[at], 0)
                out.append((*row[:at], new, *row[at + 1 :], found))
            yield out

    kinds = dict(inner.dtypes)
    done = map_rows(inner, names, run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "n_found long"]))
    return done.drop("n_found").toDF(*keep) if "n_found" in keep else done.toDF(*keep, "n_found")
