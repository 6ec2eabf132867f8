"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Matches are validated first (card numbers by Luhn, IBANs by mod 97, dates by the calendar,
social security numbers by their ranges, addresses of the Internet by their parts). A value's
digits and letters are then permuted within their format: ``permute`` is a Feistel network
over the integers below the format's size, cycle-walked, keyed by HMAC of key and format. So
equal values become equal pseudonyms in all documents, distinct ones stay distinct, and
whoever has the key can go back (``restore``). What makes a value valid is kept: a card
keeps its length, a Luhn check digit and separators, an IBAN its country and check digits,
a date stays a date in its notation within the same 400 years, an e-mail address keeps the
shape of its parts, an access key its prefix.

``pseudonymise`` is one pass without a shuffle; the permutations of a worker's recent values
are cached. A value's notation does not count: an e-mail address is linked in any case, a phone
number with any separators and with or without +1, a day in any order of its parts.
``restore`` finds values again by themselves; one that only blanks part from further digits may
be read with them as another kind on the way back.

Defined results: a null text stays null with no find; an empty text stays empty; the time of a
very long text grows with its length; repeated rows change alike; of overlapping values the kind
named first in ``KINDS`` wins (e-mail before all); other columns stay as they are, but columns
named ``n_pii`` and ``pii`` give way to the result's; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
#: Characters of a value that are permuted together.
BLOCK = 256
#: Longer values are permuted anew each time, so that the kept ones stay small.
CACHED = 256
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: letters and digits of access keys.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALPHABETS = (DIGITS, LOWER, LOWER.upper())
_DAYS = 146_097  # of 400 years


@lru_cache(maxsize=4096)
def _round_key(key: bytes, tweak: str) -> bytes:
    return hmac.new(key, tweak.encode("utf-8", "surrogatepass"), hashlib.sha256).digest()


def _round(k: bytes, i: int, x: int, width: int) -> int:
    data = i.to_bytes(1, "big") + x.to_bytes(width // 8 + 1, "big")
    n = width // 8 + 1
    out = hashlib.blake2b(data, key=k, digest_size=min(64, n)).digest()
    while len(out) < n:
        out += hashlib.blake2b(out, key=k, digest_size=min(64, n - len(out))).digest()
    return int.from_bytes(out, "big") & ((1 << width) - 1)


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of the integers below ``size``."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    low = (1 << half) - 1
    k = _round_key(key, f"{tweak}/{size}")
    while True:
        a, b = x >> half, x & low
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                a, b = b ^ _round(k, i, a, half), a
            else:
                a, b = b, a ^ _round(k, i, b, half)
        x = a << half | b
        if x < size:  # else walk on: the permutation of the larger set returns to the format
            return x


def permute_shape(text: str, key: bytes, tweak: str, back: bool = False, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """Permutes the characters of the alphabets together; all others, and each one's alphabet, stay.

    More than ``BLOCK`` characters are permuted in blocks, each keyed by the new block before it.
    """
    where = [(i, a, a.index(c)) for i, c in enumerate(text) for a in alphabets if c in a]
    out, before = list(text), ""
    for begin in range(0, len(where), BLOCK):
        block = where[begin : begin + BLOCK]
        x, size = 0, 1
        for _, a, v in block:
            x, size = x * len(a) + v, size * len(a)
        x = permute(x, size, key, f"{tweak}/{len(text)}{before}", back)
        for i, a, _ in reversed(block):
            x, v = divmod(x, len(a))
            out[i] = a[v]
        known = text if back else out  # the pseudonym's characters, either way
        before = f"/{begin}/" + "".join(known[i] for i, _, _ in block)
    return "".join(out)


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _fill(text: str, digits: str) -> str:
    """``text`` with its letters and digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in text)


def _card(text: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = permute_shape(d[:-1], key, "card", back)
    return _fill(text, body + luhn_digit(body))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    v = text.replace(" ", "")
    if not 15 <= len(v) <= 34 or _mod97(v) != 1:
        return None
    body = permute_shape(v[4:], key, "iban" + v[:2], back)
    return _fill(text, v[:2] + f"{98 - _mod97(v[:2] + '00' + body):02d}" + body)


def _email(text: str, key: bytes, back: bool) -> str:
    user, _, host = text.rpartition("@")
    name, dot, top = host.rpartition(".")
    # one permutation over both parts, so that an address is linked as a whole; case stays where it is
    whole = f"{user}@{name}"
    new = permute_shape(_lower(whole), key, "email" + top.lower(), back, (DIGITS, LOWER))
    return "".join(n.upper() if "A" <= c <= "Z" else n for c, n in zip(whole, new)) + dot + top


def _lower(text: str) -> str:
    return text.translate(_TO_LOWER)


_TO_LOWER = str.maketrans(LOWER.upper(), LOWER)

#: Two-digit country calling codes; 1 and 7 stand alone, all others have three digits.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _phone(text: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 8 <= len(d) <= 15:
        return None
    # the country's code stays; a number of ten digits without one is read as North American
    code = "" if "+" not in text else d[0] if d[0] in "17" else d[:2] if d[:2] in TWO_DIGIT_CODES else d[:3]
    own = d[len(code) :]
    new = permute(int(own), 10 ** len(own), key, f"phone/{code or '1'}/{len(own)}", back)
    return _fill(text, code + str(new).zfill(len(own)))


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    a, b, c = (int(x) for x in re.split(r"[- ]", text))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    area = a - 1 if a < 666 else a - 2
    x = permute((area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, "ssn", back)
    x, c = divmod(x, 9999)
    area, b = divmod(x, 99)
    a = area + 1 if area < 665 else area + 2
    return f"{a:03d}{text[3]}{b + 1:02d}{text[6]}{c + 1:04d}"


#: Notations of dates: year first, or last.
_YEAR_FIRST = re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})")
_YEAR_LAST = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})")


def _kind_of(day: datetime.date) -> tuple[int, bool]:
    """Days of one kind are permuted among themselves: their day and month have as many digits, and their notation reads the same way."""
    return (0 if day.day < 10 else 1 if day.day < 13 else 2), day.month < 10


@lru_cache(maxsize=1)
def _calendar() -> dict[tuple[int, bool], list[int]]:
    """The days of 400 years from a year divisible by 400 on, by kind."""
    start = datetime.date(400, 1, 1).toordinal()
    out: dict[tuple[int, bool], list[int]] = {}
    for i in range(_DAYS):
        out.setdefault(_kind_of(datetime.date.fromordinal(start + i)), []).append(i)
    return out


def _new_day(day: datetime.date, key: bytes, back: bool) -> datetime.date:
    kind, cycle = _kind_of(day), day.year // 400
    days = _calendar()[kind]
    first = datetime.date(400, 1, 1).toordinal() + (cycle - 1) * _DAYS
    at = bisect_left(days, day.toordinal() - first)
    while True:
        at = permute(at, len(days), key, f"date/{cycle}/{kind}", back)
        ordinal = first + days[at]
        if ordinal >= 1:  # the year 0 is walked over
            return datetime.date.fromordinal(ordinal)


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Equal days are linked in all notations. Of day and month first, a number above 12 tells the day, else the first is."""
    if m := _YEAR_FIRST.fullmatch(text):
        year, sep, month, day = m.groups()
        names = "ymd"
    elif m := _YEAR_LAST.fullmatch(text):
        day, sep, month, year = m.groups()
        names = "dmy"
        if int(month) > 12:
            day, month, names = month, day, "mdy"
    else:
        return None
    try:
        new = _new_day(datetime.date(int(year), int(month), int(day)), key, back)
    except ValueError:
        return None
    widths = {"y": 4, "m": len(month), "d": len(day)}
    values = {"y": new.year, "m": new.month, "d": new.day}
    return sep.join(str(values[c]).zfill(widths[c]) for c in names)


def _key(text: str, key: bytes, back: bool) -> str:
    return text[:4] + permute_shape(text[4:], key, "access" + text[:4], back, (BASE32,))


def _secret(text: str, key: bytes, back: bool) -> str:
    hexadecimal = "0123456789abcdef"
    if all(c in hexadecimal for c in text):
        return permute_shape(text, key, "hex", back, (hexadecimal,))
    return permute_shape(text, key, "secret", back)


Find = Callable[[str, bytes, bool], "str | None"]
#: An address's part behind its "@", and the characters of the part before.
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_USER = re.compile(r"[\w.+%-]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses. Each is looked for from its "@" on, so that a long run without one is never scanned again."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        host = _HOST.match(text, at + 1)
        while host and begin > done and _USER.match(text, begin - 1):
            begin -= 1
        if host and begin < at:
            yield begin, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


#: Kind, pattern (its group ``v``, else the whole match, is the value) and permutation, in order of precedence behind e-mail.
KINDS: tuple[tuple[str, str, Find], ...] = (
    ("secret", r"(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9+/_.-]{8,})", _secret),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])", _key),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("date", r"(?<![\d/.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d]|[/-]\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}([- ])\d{2}\1\d{4}(?![\d-])", _ssn),
    ("card", r"(?<![\d])\d(?:[ -]?\d){12,18}(?![\d])", _card),
    ("phone", r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\w.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])", _phone),
)
_PATTERNS = tuple((kind, re.compile(p), f) for kind, p, f in KINDS)
_MAY = re.compile(r"[0-9@]|(?i:password|passwd|secret|token|api[_-]?key)")


def _finds(text: str, at: int, key: bytes, back: bool) -> str | None:
    return _email(text, key, back) if at < 0 else _PATTERNS[at][2](text, key, back)


def _is_earlier(text: str, at: int) -> bool:
    """Whether a kind of higher precedence takes the value, or a part of it."""
    if at >= 0 and next(_emails(text), None):
        return True
    for kind, pattern, find in _PATTERNS[: max(at, 0)]:
        m = pattern.search(text)
        while m:
            start, end = m.span("v") if "v" in pattern.groupindex else m.span()
            if find(text[start:end], b"", False) is not None:
                return True
            m = pattern.search(text, m.start() + 1)
    return False


@lru_cache(maxsize=100_000)
def _replaced(at: int, text: str, key: bytes, back: bool) -> str | None:
    new = _finds(text, at, key, back)
    if new is None or _is_earlier(text, at):
        return new
    while _is_earlier(new, at):  # walk on, so that the way back reads the value as the same kind
        new = _finds(new, at, key, back)
    return new


def rewrite(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and the finds (kind, start, end in the given text)."""
    if not _MAY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []

    def take(at: int, kind: str, start: int, end: int) -> bool:
        place = bisect_left(found, (start,))
        if place < len(found) and found[place][0] < end or place and found[place - 1][1] > start:
            return False  # a kind of higher precedence holds it
        new = _replaced(at, text[start:end], key, back) if end - start <= CACHED else _replaced.__wrapped__(at, text[start:end], key, back)
        if new is not None:
            insort(found, (start, end, kind, new))
        return new is not None

    for start, end in _emails(text):
        take(-1, "email", start, end)
    for at, (kind, pattern, _) in enumerate(_PATTERNS):
        m = pattern.search(text)
        while m:
            start, end = m.span("v") if "v" in pattern.groupindex else m.span()
            # what fails may hide a value that begins later within it
            m = pattern.search(text, m.end() if take(at, kind, start, end) else m.start() + 1)
    out, done = [], 0
    for start, end, _, new in found:
        out += (text[done:start], new)
        done = end
    return "".join((*out, text[done:])), [(kind, a, b) for a, b, kind, _ in found]


def pseudonymise(docs: DataFrame, key: bytes, finds: bool = True) -> DataFrame:
    """``docs`` with the new ``text`` and, with ``finds``, ``n_pii`` and ``pii`` (kind, start and end in the old text)."""
    if finds:
        docs = docs.drop("n_pii", "pii")
    at = docs.columns.index("text")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [rewrite(t.as_py(), key) if t.is_valid else (None, []) for t in batch.column(at)]
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at] = pa.array([text for text, _ in done], pa.string())
            if finds:
                columns.append(pa.array([len(f) for _, f in done], pa.int32()))
                columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in done], spans))
                names += ["n_pii", "pii"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = T.StructType(list(docs.schema.fields))
    if finds:
        span = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
        kind = kind.add("n_pii", T.IntegerType()).add("pii", T.ArrayType(span))
    return docs.mapInArrow(run, kind)


def restore(text: str, key: bytes) -> str:
    """The original of a text that ``rewrite`` changed."""
    return rewrite(text, key, back=True)[0]
