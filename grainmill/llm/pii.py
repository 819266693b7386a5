"""Format-preserving Feistel pseudonyms of validated numbers and dates, and of mail addresses.

Found and validated: payment card numbers (Luhn), IBANs (mod 97), social security numbers, phone
numbers, IPv4 addresses, calendar dates (years of four digits in any order and with English month
names, or two digits last) and mail addresses. Each value is read as a number
below the size of its format, permuted by a keyed Feistel network (walking cycles until the
result is in the format again), and written back with its own separators and with a fresh
check digit. The key and the kind alone fix the permutation, so equal values get
equal pseudonyms in every document, however they are written, and nothing but the key is shared between
tasks. A phone number keeps its country code, if it has one; what is permuted is the number within the country.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
KINDS = ("mail", "iban", "card", "ssn", "phone", "ip", "date")
_SHORT = datetime.date(1969, 1, 1).toordinal(), datetime.date(2068, 12, 31).toordinal()
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?i:" + "|".join(rf"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS).replace("Sep(?:", "Sep(?:t|") + r")\.?"
_NTH = r"\d{1,2}(?i:st|nd|rd|th)?"
_DATES = "|".join((
    r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{1,2}/\d{1,2}", r"\d{4}\.\d{2}\.\d{2}",
    r"\d{1,2}[./]\d{1,2}[./]\d{4}", r"\d{1,2}-\d{1,2}-\d{4}",
    r"\d{1,2}/\d{1,2}/\d{2}", r"\d{2}\.\d{2}\.\d{2}", r"\d{2}-\d{2}-\d{2}",
    rf"{_NTH}(?: (?:of )?|-){_MONTH}(?:,? |-)\d{{4}}", rf"\d{{1,2}}-{_MONTH}-\d{{2}}", rf"{_MONTH} {_NTH},? \d{{4}}",
))
_BEFORE = (
    r"(?P<mail>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    rf"|(?P<date>(?<![\w./-])(?:{_DATES})(?:(?=[Tt]\d\d)|(?![\w]|[./-]\d)))"
    r"|(?P<ssn>(?<![\w-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?![\w-]))"
)
_RUN = r"|(?P<run>(?<!\w)\d(?:[ -]?\d){12,}(?!\w|[./]\d))"
_AFTER = r"|(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<!\w)\+\d{8,15}(?!\w))"
_FIND, _REST = re.compile(_BEFORE + _RUN + _AFTER, re.ASCII), re.compile(_BEFORE + _AFTER, re.ASCII)
_LIKELY, _GROUP, _MARK, _WORDS = re.compile(r"[0-9@]"), re.compile(r"[0-9]+"), re.compile(r"[^0-9]"), re.compile(r"[A-Za-z]+")
# Country codes of one and of two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Lengths of the groups in which card numbers of several groups are written.
CARD_GROUPS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1))


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of [0, size)."""
    half = max(1, (max(2, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(f"{tweak}:{size}:{r}:{right}".encode(), key=key, digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _refill(pattern: str, chars: str) -> str:
    """`chars` in the places of the letters and digits of `pattern`."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _luhn(digits: str) -> int:
    """The sum that is divisible by ten for a valid number."""
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))


def _mixed(text: str, key: bytes, tweak: str) -> str:
    """Permutes letters among letters and digits among digits; case and the rest stay."""
    value, size, places = 0, 1, []
    for c in text:
        if c.isascii() and c.isalnum():
            base, d = (10, int(c)) if c.isdigit() else (26, ord(c.lower()) - 97)
            value, size = value * base + d, size * base
            places.append(base)
    if size < 2:
        return text
    value, out = permute(value, size, key, f"{tweak}:{''.join('d' if b == 10 else 'l' for b in places)}"), []
    for base in reversed(places):
        value, d = divmod(value, base)
        out.append(str(d) if base == 10 else chr(97 + d))
    it, res = iter(reversed(out)), []
    for c in text:
        if c.isascii() and c.isalnum():
            n = next(it)
            c = n.upper() if c.isupper() else n
        res.append(c)
    return "".join(res)


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if _luhn(d) % 10 or len(set(d)) == 1:
        return None
    body = f"{permute(int(d[:-1]), 10 ** (len(d) - 1), key, 'card'):0{len(d) - 1}d}"
    return _refill(text, body + str(-_luhn(body + "0") % 10))


def _iban(text: str, key: bytes) -> str | None:
    c = text.replace(" ", "").upper()
    number = lambda s: int("".join(str(int(x, 36)) for x in s))
    while len(c) >= 15 and not (len(c) <= 34 and number(c[4:] + c[:4]) % 97 == 1):
        # a short word that follows may have been taken for the last group
        text, space, _ = text.rpartition(" ")
        if not space:
            return None
        c = text.replace(" ", "").upper()
    if len(c) < 15:
        return None
    body = _mixed(c[4:], key, "iban" + c[:2])
    new = f"{c[:2]}{98 - number(body + c[:2] + '00') % 97:02d}{body}"
    return _refill(text, new if text[:2].isupper() else new.lower())


def _ssn(text: str, key: bytes) -> str | None:
    a, g, s = (int(x) for x in _GROUP.findall(text))
    if not 0 < a < 900 or a == 666 or not g or not s:
        return None
    area = a - 1 - (a > 666)
    x = permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
    x, s = divmod(x, 9999)
    area, g = divmod(x, 99)
    return _refill(text, f"{area + 1 + (area + 1 >= 666):03d}{g + 1:02d}{s + 1:04d}")


def _phone(text: str, key: bytes) -> str | None:
    places, code = [k for k, c in enumerate(text) if c.isdigit()], 0
    if text[0] == "+":
        d = _digits(text)
        code = next(n for n in (1, 2, 3) if n == 3 or d[:n] in _CODES)
    at = places[code]
    d = _digits(text[at:])
    if not 7 <= len(d) <= 13:
        return None
    return text[:at] + _refill(text[at:], f"{permute(int(d), 10 ** len(d), key, 'phone'):0{len(d)}d}")


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _new_day(y: int, m: int, d: int, key: bytes, short: bool = False) -> datetime.date | None:
    """The pseudonym of a day among those of 1900 to 2099, or all others; of a year of two digits among 1969 to 2068."""
    try:
        day = datetime.date(y + (2000 if y < 69 else 1900) if short else y, m, d).toordinal()
    except ValueError:
        return None
    if short:
        size = _SHORT[1] - _SHORT[0] + 1
        return datetime.date.fromordinal(_SHORT[0] + permute(day - _SHORT[0], size, key, "short date"))
    size = _LAST - _FIRST + 1
    if _FIRST <= day <= _LAST:
        return datetime.date.fromordinal(_FIRST + permute(day - _FIRST, size, key, "date"))
    other = permute(day - 1 if day < _FIRST else day - 1 - size, datetime.date.max.toordinal() - size, key, "date")
    return datetime.date.fromordinal(other + 1 if other + 1 < _FIRST else other + 1 + size)


def _named_date(text: str, key: bytes) -> str | None:
    """A date with the month's name: written with a name as long, in the same case, and the day's ending."""
    name = next(m for m in _WORDS.finditer(text) if m[0].lower() not in ("st", "nd", "rd", "th", "of"))
    day, year = (m for m in _GROUP.finditer(text))
    short = len(year[0]) == 2
    new = _new_day(int(year[0]), 1 + next(k for k, m in enumerate(_MONTHS) if name[0][:3].lower() == m[:3].lower()), int(day[0]), key, short)
    if new is None:
        return None
    whole = len(name[0]) > 4 or name[0].lower() in ("may", "june", "july") and text[name.end()] not in ".-"
    month = _MONTHS[new.month - 1][: None if whole else 3]
    month = month.upper() if name[0].isupper() else month.lower() if name[0].islower() else month
    number = f"{new.day:02d}" if day[0][0] == "0" else str(new.day)
    ending, at = text[day.end() : day.end() + 2], day.end()
    if ending.lower() in ("st", "nd", "rd", "th"):
        right = "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        number, at = number + (right.upper() if ending.isupper() else right), at + 2
    parts = sorted([(day.start(), at, number), (*name.span(), month), (*year.span(), f"{new.year % 100:02d}" if short else f"{new.year:04d}")])
    out, done = "", 0
    for lo, hi, x in parts:
        out, done = out + text[done:lo] + x, hi
    return out


def _date(text: str, key: bytes) -> str | None:
    if _WORDS.search(text):
        return _named_date(text, key)
    parts = re.split(r"[./-]", text)
    y, m, d = map(int, parts if len(parts[0]) == 4 else reversed(parts))
    swapped = m > 12 >= d  # month first
    new = _new_day(y, *((d, m) if swapped else (m, d)), key, len(parts[0]) < 4 and len(parts[2]) == 2)
    if new is None:
        return None
    sep = text[len(parts[0])]
    if len(parts[0]) == 4:
        return new.isoformat().replace("-", sep)
    a, b = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{a:02d}{sep}{b:02d}{sep}" + (f"{new.year % 100:02d}" if len(parts[2]) == 2 else f"{new.year:04d}")


def _mail(text: str, key: bytes) -> str | None:
    local, _, domain = text.partition("@")
    return f"{_mixed(local, key, 'mail')}@{domain}"


_WRITE = {"mail": _mail, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


def _windows(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Places written like a card number among the groups of digits from `start` to `end`, by start, longest first."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    for i, (a, b) in enumerate(groups):
        for sizes in CARD_GROUPS:
            part = groups[i : i + len(sizes)]
            marks = {text[y] for _, y in part[:-1]}
            if sizes[-1] < 4 and part[-1][1] < end:
                marks.add(text[part[-1][1]])  # a short tail tied to more digits by another mark belongs to those
            if tuple(y - x for x, y in part) == sizes and len(marks) == 1:
                yield a, part[-1][1]
        if 13 <= b - a <= 19:
            yield a, b


def _cards(text: str, start: int, end: int, key: bytes) -> list[tuple[int, int, str | None]]:
    """(start, end, new text) of the card numbers in a run of digits, and without a new text of what only looks like one."""
    digits, marks = len(_digits(text[start:end])), set(_MARK.findall(text, start, end))
    if digits <= 19 and len(marks) < 2 and (new := _card(text[start:end], key)):
        return [(start, end, new)]
    found, at = [], start
    for a, b in _windows(text, start, end):
        if a >= at and (new := _card(text[a:b], key)):
            found.append((a, b, new))
            at = b
    gaps = zip([start, *(b for _, b, _ in found)], [*(a for a, _, _ in found), end], strict=True)
    for lo, hi in list(gaps):
        at = lo
        for a, b in _windows(text, lo, hi):
            if a >= at:
                found.append((a, b, None))
                at = b
    return sorted(found, key=lambda w: w[:2])


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind.

    A run of digits may hold several numbers: cards are taken out of it first, and what is
    written like a card but isn't valid stays; the rest is searched for the other kinds.
    """
    counts: dict[str, int] = {}
    if not _LIKELY.search(text):
        return text, counts
    out: list[str] = []

    def walk(find: re.Pattern, start: int, end: int) -> None:
        at = start
        for m in find.finditer(text, start, end):
            out.append(text[at : m.start()])
            kind, at = m.lastgroup, m.end()
            if kind == "run":
                done = m.start()
                for a, b, new in _cards(text, done, at, key):
                    walk(_REST, done, a)
                    write("card", text[a:b], new)
                    done = b
                walk(_REST, done, at)
            else:
                write(kind, m[0], _WRITE[kind](m[0], key))
        out.append(text[at:end])

    def write(kind: str, old: str, new: str | None) -> None:
        if new is not None:
            counts[kind] = counts.get(kind, 0) + 1
        out.append(old if new is None else new)

    walk(_FIND, 0, len(text))
    return "".join(out), counts


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced and n_<kind> of every document.

    A null text stays null, with no replacements; an empty one stays empty. Rows that repeat each
    give a row; null doc_ids stay; other columns are left aside. An empty table gives
    an empty one. Who has the key can undo pseudonyms; it must not be empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for t in batch.column(1).to_pylist():
                new, counts = pseudonymise(t, key) if t is not None else (None, {})
                texts.append(new)
                found.append(counts)
            cols = [pa.array([c.get(k, 0) for c in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([sum(c.values()) for c in found], pa.int64()), *cols], ["doc_id", "text", "n_replaced", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, text string, n_replaced long, " + ", ".join(f"{n} long" for n in names))
