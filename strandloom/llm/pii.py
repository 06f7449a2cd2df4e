"""Format-preserving pseudonyms of personal data.

Validated numbers, dates and addresses are permuted within their format by a keyed Feistel network, so that equal
values get equal pseudonyms in all documents, different values different ones, and a card number stays one with a
valid check digit, a date a date. With the key they can be undone, without it they can't.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

ship(__name__)

KINDS = ["email", "card", "number", "phone", "ssn", "ipv4", "date"]
#: Each run of characters is gone through once: from its beginning, and without going back.
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++")
OTHERS = re.compile(
    r"""(?P<date>(?<![\w.-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\w-]))
    |(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
    |(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
    |(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\w))
    |(?P<number>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))""",
    re.X,
)
#: Few texts have as many digits in a row, or dates or addresses; the others are passed over.
DIGITS = re.compile(r"\d[\d.()/ +-]{6}")
ROUNDS = 10
#: Dates of these years are permuted among themselves, all others among the others.
EPOCH, DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
ALL_DAYS = dt.date.max.toordinal()


def permute(x: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1, or its inverse: a Feistel network over the least square that holds them, walked until it is within."""
    half = isqrt(size - 1) + 1 if size > 1 else 1

    def mixed(r: int, right: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{size}|{r}|{right}".encode(), key=key, digest_size=16).digest(), "big")

    while True:
        left, right = divmod(x, half)
        for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            if undo:
                left, right = (right - mixed(r, left)) % half, left
            else:
                left, right = right, (left + mixed(r, right)) % half
        x = left * half + right
        if x < size:
            return x


def permute_within(x: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool], undo: bool = False) -> int:
    """A permutation of the valid numbers below size, or its inverse; x must be valid."""
    x = permute(x, size, key, tweak, undo)
    while not valid(x):
        x = permute(x, size, key, tweak, undo)
    return x


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(d: str, key: bytes, undo: bool) -> str:
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, "card", undo)).zfill(len(d) - 1)
    return body + next(c for c in "0123456789" if luhn(body + c))


def _number(d: str, key: bytes, undo: bool) -> str:
    n = len(d)
    return str(permute_within(int(d), 10**n, key, "number", lambda x: not luhn(str(x).zfill(n)), undo)).zfill(n)


def ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _letters(page: int) -> str:
    """Lower-case letters, and letters without case, of a page of 256 code points, without ASCII."""
    return "".join(c for c in map(chr, range(256 * page, 256 * page + 256)) if c.isalpha() and c == c.lower() and not c.isascii())


def _alphabet(c: str) -> str:
    """The characters that c may become: digits, the letters a-z, the letters of its page, or itself alone."""
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else c
    return letters if c in (letters := _letters(ord(c) >> 8)) else c


def _email(value: str, key: bytes, undo: bool) -> str | None:
    """Permutes the letters and digits of the part before @ (upper case becomes lower); other characters stay. None if there is none."""
    local, _, domain = value.partition("@")
    local = local.lower()
    alphabets = [_alphabet(c) for c in local]
    x, size = 0, 1
    for c, a in zip(local, alphabets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    if size == 1:
        return None
    x = permute(x, size, key, "email|" + "".join(a[0] for a in alphabets), undo)
    out = []
    for a in reversed(alphabets):
        x, d = divmod(x, len(a))
        out.append(a[d])
    return "".join(reversed(out)) + "@" + domain


def _date(value: str, key: bytes, undo: bool) -> str | None:
    """Dates of year-month-day and day-month-year share a permutation. Others, of month-day-year, have days over 12 and become such days."""
    sep = "-" if value[4] == "-" else value[2]
    a, b, c = (int(p) for p in value.split(sep))
    try:
        day = dt.date(a, b, c) if sep == "-" else dt.date(c, b, a) if b <= 12 else dt.date(c, a, b)
    except ValueError:
        return None
    us = sep != "-" and b > 12
    x = day.toordinal() - 1
    near = EPOCH <= x + 1 < EPOCH + DAYS
    start, size = (EPOCH - 1, DAYS) if near else (0, ALL_DAYS)

    def valid(x: int) -> bool:
        return (near or not EPOCH <= x + 1 < EPOCH + DAYS) and (not us or dt.date.fromordinal(x + start + 1).day > 12)

    new = dt.date.fromordinal(start + 1 + permute_within(x - start, size, key, f"date|{near}|{us}", valid, undo))
    if sep == "-":
        return new.isoformat()
    first, second = (new.month, new.day) if us else (new.day, new.month)
    return f"{first:02}{sep}{second:02}{sep}{new.year:04}"


def pseudonym(kind: str, value: str, key: bytes, undo: bool = False) -> tuple[str, str] | None:
    """(kind, pseudonym) of a match, None if it isn't valid; with undo, of a pseudonym the value. Its digits alone decide, so that other spacing links too."""
    d = re.sub(r"\D", "", value)
    if not value.isascii() and kind != "email":
        return None
    if kind == "email":
        return (kind, out) if (out := _email(value, key, undo)) else None
    if kind == "date":
        return (kind, out) if (out := _date(value, key, undo)) else None
    if kind == "ssn":
        if not ssn_valid(d):
            return None
        return kind, _fill(value, str(permute_within(int(d), 10**9, key, kind, lambda x: ssn_valid(str(x).zfill(9)), undo)).zfill(9))
    if kind == "ipv4":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, kind, undo)
        return kind, ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "phone":
        new = str(permute(int(d[-10:]), 10**10, key, kind, undo)).zfill(10)
        return kind, _fill(value, d[:-10] + new)
    return ("card", _fill(value, _card(d, key, undo))) if luhn(d) else ("number", _fill(value, _number(d, key, undo)))


def _rewrite(text: str | None, known: Callable, undo: bool = False) -> tuple[str | None, Counter]:
    n: Counter = Counter()

    def swap(kind: str, value: str) -> str:
        if not (new := known(kind, value)):
            return value
        n[new[0]] += 1
        return new[1]

    def mail(m: re.Match) -> str:
        rest = m[0].lstrip("_.+-")  # marks before the first letter or digit are no part of an address
        return m[0] if rest[0] == "@" else m[0][: len(m[0]) - len(rest)] + swap("email", rest)

    for mails in (False, True) if undo else (True, False):
        if mails and text and "@" in text:
            text = EMAIL.sub(mail, text)
        if not mails and text and DIGITS.search(text):
            text = OTHERS.sub(lambda m: swap(m.lastgroup, m[0]), text)
    return text, n


def _run(key: bytes, undo: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(100_000)(lambda kind, value: pseudonym(kind, value, key, undo))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            done = [_rewrite(t, known, undo) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            names = batch.schema.names
            if not undo:
                columns += [pa.array([n[k] for _, n in done], pa.int64()) for k in KINDS]
                names = [*names, *[f"n_{k}" for k in KINDS]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def restore(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with the text as it was before pseudonymize() with this key, but for upper case in addresses."""
    return docs.mapInArrow(_run(key, True), docs.schema)


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text rewritten, and n_email, n_card, n_number, n_phone, n_ssn, n_ipv4 and n_date (longs), values replaced.

    Valid are: dates of the calendar (2001-02-03, 03/02/2001 day first, or month first if only that is a date, 03.02.2001);
    social security numbers but those never given; addresses of octets up to 255; phone numbers of ten digits in groups and a country code, which
    stays (plans of numbers are not looked up); numbers of 13 to 19 digits, as cards if their check digit holds and else as numbers that
    never become cards. Dates from 1900 to 2099 stay within these years, others outside them. Of emails the letters and digits before @ are permuted,
    letters beyond ASCII within their page of 256 code points; domains stay. Values that can't change are not counted.

    Null texts stay null, texts without a value stay as they are; time grows with the length of a text. Rows that
    repeat a document each come back the same. Other columns stay; ones with the names of added columns are replaced.
    """
    counts = [f"n_{k}" for k in KINDS]
    base = docs.drop(*counts)
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return base.mapInArrow(_run(key), schema)
