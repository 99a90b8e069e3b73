"""Operator 1. Format-preserving Feistel pseudonyms for personal data.

Numbers that pass their own check (Luhn for payment cards, mod 97 for IBANs, octets for IPv4, the reserved ranges of
social security numbers, dialling shape for telephone numbers), calendar dates, e-mail addresses and assigned
credentials are replaced by a keyed permutation of the set of all values of the same format. The permutation is an
alternating Feistel network over the exact domain, cycle-walked where the domain isn't a product, so equal values get
equal pseudonyms in every document and two values never share one. Check digits are computed anew; separators, letter
case, field widths, country codes and top-level domains stay. Digits that fail the check are left as they are. Nothing
is too long to be replaced. Who has the key can undo the permutation, so it is no part of the code: the production query
takes it from the session's setting ``spark.docketry.pii.key``; where that is unset, a random one serves the session.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docketry.llm import common

ROUNDS = 8
_D0, _D1 = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal()
_LAST = dt.date.max.toordinal()


def feistel(x: int, n: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(n): Feistel over a near-square grid a x b that holds n cells, walked until the
    value is below n again."""
    if n <= 1:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    tag = kind.encode()
    while True:
        left, right = divmod(x, b)
        for r in range(0, ROUNDS, 2):
            left = (left + _round(key, tag, r, right, a)) % a
            right = (right + _round(key, tag, r + 1, left, b)) % b
        x = left * b + right
        if x < n:
            return x


def _round(key: bytes, tag: bytes, r: int, half: int, n: int) -> int:
    """A keyed number that is wider than n, so that it moves every digit of the other half."""
    raw = half.to_bytes(max(1, (half.bit_length() + 7) // 8), "big")
    wide = (n.bit_length() + 7) // 8 + 16
    size = max(16, min(64, len(raw) + 16)) if wide <= 64 else 64
    digest = hashlib.blake2b(bytes([r]) + tag + b"\0" + raw, key=key, digest_size=size).digest()
    return int.from_bytes(digest if wide <= 64 else hashlib.shake_256(digest).digest(wide), "big")


def _walk(x: int, n: int, key: bytes, kind: str, ok: Callable[[int], bool]) -> int:
    while True:
        x = feistel(x, n, key, kind)
        if ok(x):
            return x


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = ord(c) - 48
        total += (2 * d - 9 * (d > 4)) if i % 2 == 0 else d
    return str(-total % 10)


def card(s: str, key: bytes) -> str | None:
    """Luhn-valid number of 13 to 19 digits; whether it starts with 0 stays, the check digit is computed anew."""
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    low = 0 if d[0] == "0" else 10 ** (n - 1)
    size = 10 ** (n - 1) if d[0] == "0" else 9 * 10 ** (n - 1)
    body = f"{low + feistel(int(d[:-1]) - low, size, key, f'card{n}{d[0] == '0'}'):0{n}d}"
    return _refill(s, body + luhn_digit(body))


def iban(s: str, key: bytes) -> str | None:
    """mod-97-valid IBAN; country and letters stay, digits of the account are permuted, check digits computed anew."""
    flat = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    digits = re.sub(r"\D", "", flat[4:])
    if not digits:
        return None
    account = _refill(flat[4:], f"{feistel(int(digits), 10 ** len(digits), key, 'iban' + flat[:2] + re.sub(r'[0-9]', '9', flat[4:])):0{len(digits)}d}")
    new = iter(flat[:2] + f"{98 - number(account + flat[:2] + '00') % 97:02d}" + account)
    return "".join(c if c == " " else next(new) for c in s)


def ipv4(s: str, key: bytes) -> str | None:
    octets = s.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    x = feistel(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, x.to_bytes(4, "big")))


def ssn(s: str, key: bytes) -> str | None:
    ok = lambda x: (x // 10**6) not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 != 0 and x % 10**4 != 0
    x = int(s[:3] + s[4:6] + s[7:])
    if not ok(x):
        return None
    new = f"{_walk(x, 10**9, key, 'ssn', ok):09d}"
    return _refill(s, new)


#: Country codes of two digits; those that begin with 1 or 7 have one, all others three.
_TWO = {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def phone(s: str, key: bytes) -> str | None:
    """8 to 15 digits; the country code of an international number stays."""
    d = re.sub(r"\D", "", s)
    if not 8 <= len(d) <= 15:
        return None
    keep = 0 if not s.lstrip("(").startswith("+") else 1 if d[0] in "17" else 2 if d[:2] in _TWO else 3
    rest = d[keep:]
    return _refill(s, d[:keep] + f"{feistel(int(rest), 10 ** len(rest), key, f'phone{d[:keep]}.{len(rest)}'):0{len(rest)}d}")


def _ordinal(y: str, m: str, d: str) -> int | None:
    try:
        return dt.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None


def _form(x: int) -> tuple[bool, bool, bool]:
    """What a date's written form can show of its day: one-digit day or month, and a day that can't be a month."""
    d = dt.date.fromordinal(x)
    return d.day < 10, d.month < 10, d.day > 12


def _day(x: int, key: bytes) -> dt.date:
    """Days of 1900 to 2099 stay among them, the other days of the calendar among those, and either among the days that
    can be written in the same forms."""
    form = _form(x)
    if _D0 <= x < _D1:
        return dt.date.fromordinal(_D0 + _walk(x - _D0, _D1 - _D0, key, "day", lambda v: _form(v + _D0) == form))
    return dt.date.fromordinal(1 + _walk(x - 1, _LAST, key, "days", lambda v: not _D0 <= v + 1 < _D1 and _form(v + 1) == form))


def date(s: str, key: bytes) -> str | None:
    """yyyy-mm-dd (also with / or .), dd/mm/yyyy, or mm/dd/yyyy where only that is a date; day and month may have one
    digit. One permutation of days for all forms, so a date stays linked across them and each field keeps its width:
    whether day and month are below 10, and whether the day is above 12, is part of the format."""
    a, sep, b, sep2, c = re.match(r"(\d+)(.)(\d+)(.)(\d+)$", s).groups()
    if sep != sep2:
        return None
    for names, y, m, d in (("ymd", a, b, c),) if len(a) == 4 else (("dmy", c, b, a), ("mdy", c, a, b)):
        if (x := _ordinal(y, m, d)) is not None:
            new = _day(x, key)
            parts = {"y": new.year, "m": new.month, "d": new.day}
            return sep.join(f"{parts[k]:0{len(old)}d}" for k, old in zip(names, (a, b, c), strict=True))
    return None


#: Digits of a number that are joined one by one.
_FEW = 256
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(4096)
def _alphabet(block: int, category: str) -> str:
    """The letters or digits of one category among 256 code points, without those of ASCII."""
    return "".join(c for c in map(chr, range(max(128, block << 8), (block + 1) << 8)) if unicodedata.category(c) == category)


def _class(c: str) -> tuple[str, str]:
    """The signs that may stand for this one, and a name for them; itself if it is no letter or digit."""
    if c.isascii():
        i = next((i for i, x in enumerate(_ALPHABETS) if c in x), None)
        return ("", c) if i is None else (_ALPHABETS[i], str(i))
    kind = unicodedata.category(c)
    return (_alphabet(ord(c) >> 8, kind), f"<{ord(c) >> 8}{kind}>") if kind in ("Ll", "Lu", "Lt", "Lm", "Lo", "Nd") else ("", c)


def _join(digits: list[int], sizes: list[int]) -> tuple[int, int, list]:
    """The number of mixed radix, the size of its domain and the halves that it was made of; by halves, so that long
    values take no quadratic time."""
    if len(digits) <= _FEW:
        x, n = 0, 1
        for d, size in zip(digits, sizes, strict=True):
            x, n = x * size + d, n * size
        return x, n, sizes
    h = len(digits) // 2
    x, n, left = _join(digits[:h], sizes[:h])
    y, m, right = _join(digits[h:], sizes[h:])
    return x * m + y, n * m, [left, m, right]


def _split(x: int, parts: list) -> list[int]:
    """The digits again."""
    if len(parts) == 3 and isinstance(parts[0], list):
        x, y = divmod(x, parts[1])
        return _split(x, parts[0]) + _split(y, parts[2])
    out = []
    for size in reversed(parts):
        x, r = divmod(x, size)
        out.append(r)
    return out[::-1]


def _letters(s: str, key: bytes, kind: str) -> str:
    """Every letter and digit within its own class (of its alphabet and case), as one number of mixed radix; others stay."""
    classes = [_class(c) for c in s]
    sets, shape = [x for x, _ in classes], "".join(name for _, name in classes)
    x, n, parts = _join([x_set.index(c) for c, x_set in zip(s, sets, strict=True) if x_set], [len(x_set) for x_set in sets if x_set])
    new = iter(_split(feistel(x, n, key, kind + shape), parts))
    return "".join(x_set[next(new)] if x_set else c for c, x_set in zip(s, sets, strict=True))


def email(s: str, key: bytes) -> str | None:
    """All but the top-level domain, each letter or digit within its class; letter case is part of the format."""
    head, _, top = s.rpartition(".")
    return _letters(head, key, "mail") + "." + top


def secret(s: str, key: bytes) -> str | None:
    """Value assigned to a credential's name, of 16 characters or more with a digit; hexadecimal stays hexadecimal."""
    if not any(c.isdigit() for c in s):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        new = f"{feistel(int(s, 16), 16 ** len(s), key, f'hex{len(s)}'):0{len(s)}x}"
        return new.upper() if s != s.lower() else new
    return _letters(s, key, "secret")


#: In this order: a later kind doesn't look inside what an earlier one replaced.
KINDS: tuple[tuple[str, str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", "@", r"(?<![\w.%+-])[\w.%+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}", email),
    ("secret", "=:", r"(?i:(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key))[\"']?\s*[:=]\s*[\"']?()([A-Za-z0-9/+_-]{16,})", secret),
    ("iban", "", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", iban),
    ("ipv4", ".", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\w)", ipv4),
    ("date", "", r"(?<![\w./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?:(?=[Tt]\d\d)|(?![\w/-]|\.\d))", date),
    ("card", "", r"(?<![\w.])\d{13,19}(?!\w)|(?<![\w.])\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\w)|(?<![\w.])\d{4}([ -])\d{6}\2\d{5}(?!\w)", card),
    ("ssn", "-", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("phone", "", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])", phone),
)
_COMPILED = [(k, need, re.compile(p, re.ASCII if k not in ("email",) else 0), f) for k, need, p, f in KINDS]
_DIGIT = re.compile("[0-9]")


_LONG = 256


@lru_cache(100_000)
def _swap_short(kind: int, s: str, key: bytes) -> str | None:
    return _COMPILED[kind][3](s, key)


def _swap(kind: int, s: str, key: bytes) -> str | None:
    """Long values aren't kept, so that the memory of what was swapped is bounded."""
    return _swap_short(kind, s, key) if len(s) <= _LONG else _COMPILED[kind][3](s, key)


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with its personal data replaced, and how many of each kind. Null gives null, empty gives empty."""
    found: dict[str, int] = {}
    if not text:
        return text, found
    digits = _DIGIT.search(text) is not None
    if not digits and "@" not in text:
        return text, found
    done: list[tuple[int, int, str]] = []
    for i, (kind, need, pattern, _) in enumerate(_COMPILED):
        if (kind != "email" and not digits) or (need and not any(c in text for c in need)):
            continue
        group = 2 if kind == "secret" else 0
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if any(a < y and x < b for x, y, _ in done):
                continue
            new = _swap(i, text[a:b], key)
            if new is not None:
                done.append((a, b, new))
                found[kind] = found.get(kind, 0) + 1
    if not done:
        return text, found
    done.sort()
    out, at = [], 0
    for a, b, new in done:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def _batches(key: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [pseudonymise(t, key) for t in batch.column("text").to_pylist()]
        texts = pa.array([t for t, _ in pairs], pa.string())
        maps = pa.array([sorted(f.items()) for _, f in pairs], pa.map_(pa.string(), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, maps], ["doc_id", "text", "pii_found"])


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, pii_found) for every row of ``docs``, which needs doc_id and text; one narrow stage, no shuffle.
    Values stay linked wherever the same key of 1 to 64 bytes is used.

    Null text gives null text and an empty map; empty text stays empty; repeated rows are each transformed alike; an
    empty table gives an empty table; further columns are ignored. Whole texts are searched, however long.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    common.small_batches(docs.sparkSession)
    d = common.pick(docs, "doc_id", "text")
    schema = T.StructType([d.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("pii_found", T.MapType(T.StringType(), T.IntegerType()))])
    return d.mapInArrow(partial(_batches, key), schema)


_SESSION_KEY = secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """A digest of the setting ``spark.docketry.pii.key``, or this process's random key where it is unset."""
    named = spark.conf.get("spark.docketry.pii.key", None) or spark.sparkContext.getConf().get("spark.docketry.pii.key", None)
    return hashlib.blake2b(named.encode(), digest_size=32).digest() if named else _SESSION_KEY


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(common.documents(spark, sf_dir), session_key(spark))


QUERIES = {"op1_pii": op1_pii}
