"""Format-preserving pseudonyms for personal data (operator 7).

Found and validated: e-mail addresses, IPv4 addresses (octets up to 255), payment card numbers (13 to 19 digits;
those that satisfy the Luhn check keep satisfying it, others are permuted as plain account numbers), IBANs (mod 97),
social security numbers (valid areas), telephone numbers (10 to 15 digits) and calendar dates from
1900 to 2099.  Words or numbers that follow an IBAN or a card can look like further groups of it: ends at
the group borders are tried too.  A value that fails its validation is left alone, and the search goes on
behind its first group.

Each value is a number below the size of its format's domain and is sent through a keyed Feistel network
on that domain: two halves of mixed radix, ``ROUNDS`` rounds, walking the cycle until the result is inside.  That is a
permutation, so equal values have equal pseudonyms in every document and different ones never
share one; separators, lengths, letter case, country codes and mail domains stay.  Kind and format are
the tweak.  Nothing is stored and nothing is joined: each text is rewritten where it is read.

The key is a parameter; ``DEMO_KEY`` is for tests and examples only.

Defined cases: null text stays null, empty text empty; a text without findings comes back as it is;
texts are read whole, however long; repeated rows are rewritten alike; an empty table gives an empty
result; other columns are passed on by ``pseudonymise`` and not read by ``find_personal``.
"""

from __future__ import annotations

import datetime
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import fresh, importable_on_workers

DEMO_KEY = b"demonstration key, replace in production"
ROUNDS = 10

_LETTERS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _LETTERS, _LETTERS.replace("ÿ", "").upper()]
_CLASS_OF = {c: (k, i) for k, cs in enumerate(_CLASSES) for i, c in enumerate(cs)}

_PATTERN = regex.compile(r"""
    (?P<email>(?<![\w.%+\-@])[\w.%+\-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*+)\.)+[A-Za-z]{2,}+)
  | (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))
  | (?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
  | (?P<date>(?<![\w./\-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?!(?!T\d\d:?\d\d)[\w/\-]|\.\d))
  | (?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))
  | (?P<card>(?<![0-9A-Za-z+])\d(?:[ \-]?\d){12,18}(?![0-9A-Za-z]))
  | (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?![\w])
      |(?<![\w+])\+\d{10,15}(?![\w])
      |(?<![\w+])(?:\+\d{1,3}[ .\-]?\d{1,2}|0\d)(?:[ .\-]\d{2}){4}(?![\w]))
""", regex.VERBOSE)
_first_group = regex.compile(r"\W*\w+").match
#: Lengths of IBANs by country; other countries take any length.
_IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_anything = regex.compile(r"[@0-9]").search


class Permutation:
    """The keyed permutations of {0, ..., size - 1}, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, size: int, r: int, x: int) -> int:
        h = hashlib.blake2b(f"{size}:{r}:{x}".encode(), key=self.key, digest_size=24)
        h.update(b":" + tweak)
        return int.from_bytes(h.digest(), "big")

    def _halves(self, size: int) -> tuple[int, int]:
        a = math.isqrt(size - 1) + 1
        return a, -(-size // a)

    def forward(self, x: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return x
        a, b = self._halves(size)
        while True:
            left, right = divmod(x, b)
            for r in range(ROUNDS):
                if r % 2:
                    right = (right + self._round(tweak, size, r, left)) % b
                else:
                    left = (left + self._round(tweak, size, r, right)) % a
            x = left * b + right
            if x < size:
                return x

    def backward(self, x: int, size: int, tweak: bytes) -> int:
        """The value whose pseudonym is ``x``: who has the key can undo the permutation."""
        if size < 2:
            return x
        a, b = self._halves(size)
        while True:
            left, right = divmod(x, b)
            for r in reversed(range(ROUNDS)):
                if r % 2:
                    right = (right - self._round(tweak, size, r, left)) % b
                else:
                    left = (left - self._round(tweak, size, r, right)) % a
            x = left * b + right
            if x < size:
                return x

    def digits(self, s: str, tweak: str) -> str:
        return str(self.forward(int(s), 10 ** len(s), f"{tweak}{len(s)}".encode())).zfill(len(s)) if s else s

    def characters(self, s: str, tweak: str) -> str:
        """Permutes letters and digits within their classes; other characters stay."""
        shape = [_CLASS_OF.get(c, (None, 0)) for c in s]
        x, size = 0, 1
        for k, i in shape:
            if k is not None:
                x, size = x * len(_CLASSES[k]) + i, size * len(_CLASSES[k])
        x = self.forward(x, size, (tweak + "".join("-" if k is None else str(k) for k, _ in shape)).encode())
        out = list(s)
        for at in range(len(s) - 1, -1, -1):
            k = shape[at][0]
            if k is not None:
                x, i = divmod(x, len(_CLASSES[k]))
                out[at] = _CLASSES[k][i]
        return "".join(out)


def luhn_digit(payload: str) -> str:
    """The digit that completes a payload so that the Luhn sum is a multiple of 10."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, account: str) -> int:
    """The remainder mod 97 with check digits 00, read as letters A = 10 to Z = 35."""
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _refill(template: str, new: str) -> str:
    """Puts the characters of ``new`` in the places of the template's letters and digits."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in template)


def _date_parts(s: str) -> tuple[list[int], str] | None:
    """Year, month and day, and their order in the text; with slashes the month comes first if it can."""
    sep = next(c for c in s if not c.isdigit())
    a, b, c = (int(x) for x in s.split(sep))
    orders = ["ymd"] if len(s.split(sep)[0]) == 4 else ["mdy", "dmy"] if sep == "/" else ["dmy"]
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            if 1900 <= datetime.date(part["y"], part["m"], part["d"]).year <= 2099:
                return [part["y"], part["m"], part["d"]], order
        except ValueError:
            pass
    return None


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1


def pseudonym(kind: str, value: str, p: Permutation) -> tuple[str, str] | None:
    """(kind, pseudonym) of a match, or None if it isn't valid."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email":
        local, _, domain = value.partition("@")
        return kind, p.characters(local, "email") + "@" + domain
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = p.forward(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip")
        return kind, ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":
        if len(set(digits)) == 1:
            return None
        if luhn_digit(digits[:-1]) == digits[-1]:
            body = p.digits(digits[:-1], "card")
            return kind, _refill(value, body + luhn_digit(body))
        return "account", _refill(value, p.digits(digits, "account"))
    if kind == "iban":
        flat = value.replace(" ", "")
        country, account = flat[:2], flat[4:]
        if not 15 <= len(flat) <= 34 or 98 - _iban_check(country, account) != int(flat[2:4]):
            return None
        new = p.characters(account, "iban" + country)
        return kind, _refill(value, f"{country}{98 - _iban_check(country, new):02d}{new}")
    if kind == "ssn":
        area, rest = int(digits[:3]), int(digits[3:])
        if not (0 < area < 900 and area != 666 and rest % 10000 and rest // 10000):
            return None
        # Areas without 666, groups and serial numbers without 0.
        x = ((area - 1 - (area > 666)) * 99 + rest // 10000 - 1) * 9999 + rest % 10000 - 1
        x, serial = divmod(p.forward(x, 898 * 99 * 9999, b"ssn"), 9999)
        area, group = divmod(x, 99)
        return kind, f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "date":
        found = _date_parts(value)
        if not found:
            return None
        (y, m, d), order = found
        day = p.forward(datetime.date(y, m, d).toordinal() - _FIRST_DAY, _DAYS, b"date")
        new = datetime.date.fromordinal(day + _FIRST_DAY)
        sep = next(c for c in value if not c.isdigit())
        named = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return kind, sep.join(named[x] for x in order)
    if not 10 <= len(digits) <= 15:
        return None
    head = regex.match(r"\+\d{1,3}(?=[ .\-(])", value)
    code = head.group() if head else ""
    rest = "".join(c for c in value[len(code):] if c.isdigit())
    return kind, code + _refill(value[len(code):], p.digits(rest, "phone"))


def _ends(kind: str, value: str) -> list[int]:
    """The lengths of a match to try, best first: other ends are group borders, as the next word may look like a group."""
    if kind not in ("iban", "card"):
        return [len(value)]
    borders = [i for i in range(len(value), 0, -1) if i == len(value) or value[i] in " -" and value[i - 1].isalnum()]
    flat = {i: "".join(c for c in value[:i] if c.isalnum()) for i in borders}
    if kind == "iban":
        usual = _IBAN_LENGTHS.get(value[:2])
        return sorted(borders, key=lambda i: (len(flat[i]) != usual, -i))
    cards = [i for i in borders if 13 <= len(flat[i]) <= 19 and len(set(flat[i])) > 1 and luhn_digit(flat[i][:-1]) == flat[i][-1]]
    # One in ten longer numbers satisfies the check by chance, so the usual length comes first.
    usual = {"2": 16, "4": 16, "5": 16, "6": 16}.get(value[0], 15 if value[:2] in ("34", "37") else 0)
    return sorted(cards, key=lambda i: (len(flat[i]) != usual, -i)) or [len(value)]


def rewrite(text: str, p: Permutation) -> tuple[str, Counter]:
    found: Counter = Counter()
    if not _anything(text):
        return text, found

    out, done, at = [], 0, 0
    while m := _PATTERN.search(text, at):
        kind, value = m.lastgroup, m.group()
        for end in _ends(kind, value):
            new = pseudonym(kind, value[:end], p)
            if new is not None:
                found[new[0]] += 1
                out += [text[done:m.start()], new[1]]
                done = at = m.start() + end
                break
        else:
            # A number of one repeated digit is no card, and no part of it is anything else.
            at = m.end() if kind == "card" else m.start() + _first_group(value).end()
    return "".join(out) + text[done:], found


def find_personal(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (rewritten), n_found, kinds (``kind:number`` by kind) for every row."""
    importable_on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for b in batches:
            texts, n, kinds = [], [], []
            for t in b.column(1):
                t = t.as_py()
                new, found = (None, Counter()) if t is None else rewrite(t, p)
                texts.append(new)
                n.append(sum(found.values()))
                kinds.append(",".join(f"{k}:{found[k]}" for k in sorted(found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())],
                                             names=["id", "text", "n_found", "kinds"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: run(fresh(b)), f"id {kind}, text string, n_found long, kinds string").select(F.col("id").alias(id_col), "text", "n_found", "kinds")


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts rewritten; all columns stay as and where they are."""
    importable_on_workers(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for b in batches:
            texts = [None if t is None else rewrite(t, p)[0] for t in (x.as_py() for x in b.column(at))]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(lambda b: run(fresh(b)), docs.schema)
