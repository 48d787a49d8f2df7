"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A value that passes its validation (a check digit, a calendar, a numbering plan) is mapped to an
integer in the range of its format, permuted there by a Feistel network with cycle walking, and
written back in its own layout with its check digits made anew. The permutation depends on the key,
the kind and the format only, so equal values become equal pseudonyms in every document, different
values of a format stay different, and the holder of the key can invert it. A date is one value in all
layouts, an e-mail address in all spellings of its case. Digits that fail their validation are left as
they are, but for +1 telephone numbers outside the numbering plan: these are permuted among themselves.

A named secret keeps the classes of its characters: digits stay digits, hexadecimal ones stay that. A card, IBAN, date, number or
address inside it gets the pseudonym it has everywhere, and the rest is permuted among values that hold none (seen by segments, so a
secret of dates, signs and digits in a row may, once in some hundred such values, not be inverted).

A value of more than ``SEGMENT`` characters is permuted in segments, each under the segments before it and,
in a second sweep, those after it, so time grows with its length and it is still a permutation.

Kinds: e-mail addresses, IPv4 addresses, payment cards (Luhn), IBANs (modulo 97), North American and
international telephone numbers, US social security numbers, calendar dates, and secrets given to
names such as ``token`` or ``password``. Digits are those of ASCII.

Defined results: a null text stays null with no finds; an empty text stays empty; every find in a long
text is replaced, however long it is, in time that grows with the text; repeated rows get equal texts; an
empty table gives no rows; a null doc_id is kept; of finds that overlap the first, then the longest, counts;
other columns are ignored, also those named like results, unless ``keep`` names them.
"""

from __future__ import annotations

import calendar
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame

from .common import arrow_rows, ids_as_long, ids_as_text

ROUNDS = 10
#: Key of the registered queries; a real run gives its own.
KEY = b"millrace pseudonyms"

#: Characters of a value that are permuted as one number.
SEGMENT = 48

#: What may stand before and after the @ of an address; searched from the @ outwards.
_AFTER_AT = re.compile(r"(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_/+-]{12,})")
_NUMERIC = re.compile(
    r"(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<iso>(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]))"
    r"|(?P<day>(?<![0-9./-])[0-9]{1,2}(?P<sep>[./-])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9]))"
    r"|(?P<card>(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
)
#: Luhn's doubled digits, and the numbers that letters of an IBAN stand for.
_DOUBLED = bytes((2 * d - 9 * (d > 4)) if 0 <= (d := c - 48) <= 9 else 0 for c in range(256))
_VALUES = {ord(c): str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_NOT_DIGIT = {c: None for c in range(128) if not 48 <= c <= 57}
_RUN = re.compile(r"\+?\(?[A-Z]*[0-9]+")
_DIGIT = re.compile(r"[0-9]")
#: Digits and letters of hexadecimal numbers, both of them.
_HEXADECIMAL = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+", re.DOTALL)
_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def permute(value: int, size: int, tweak: str, key: bytes, fits: Callable[[int], bool] | None = None, inverse: bool = False) -> int:
    """The image of ``value`` under a keyed permutation of range(size), or of those in it that fit."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    head = hashlib.blake2b(tweak.encode() + b"|" + size.to_bytes((size.bit_length() + 7) // 8, "little"), key=key[:64], digest_size=16).digest()

    def noise(turn: int, x: int) -> int:
        seed = head + bytes([turn]) + x.to_bytes(width, "little")
        blocks = [hashlib.blake2b(seed + block.to_bytes(4, "little"), digest_size=min(64, max(8, width))).digest() for block in range(-(-width // 64))]
        return int.from_bytes(b"".join(blocks)[:width], "little") & mask

    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ noise(turn, left), left
            else:
                left, right = right, left ^ noise(turn, right)
        value = left << half | right
        if value < size and (fits is None or fits(value)):
            return value


def _respell_segment(text: str, tweak: str, key: bytes, hexadecimal: bool, inverse: bool, class_of: Callable[[str], object] | None = None) -> str:
    """One segment; with ``class_of`` permuted among the texts of its class."""
    own, new = class_of and class_of(text), text
    while True:
        new = _respell_once(new, tweak, key, hexadecimal, inverse)
        if not class_of or class_of(new) == own:
            return new


def _respell_once(text: str, tweak: str, key: bytes, hexadecimal: bool, inverse: bool) -> str:
    sets = [_HEX if hexadecimal else next((a for a in (_LOWER, _UPPER, _DIGITS) if c in a), "") for c in text]
    size, value = 1, 0
    for c, a in zip(text, sets, strict=True):
        if a:
            size, value = size * len(a), value * len(a) + a.index(c)
    if size == 1:
        return text
    shape = "".join(str(len(a)) + "," if a else c for c, a in zip(text, sets, strict=True))
    value, out = permute(value, size, f"{tweak}|{shape}", key, None, inverse), []
    for c, a in zip(reversed(text), reversed(sets), strict=True):
        if a:
            value, digit = divmod(value, len(a))
            c = a[digit]
        out.append(c)
    return "".join(reversed(out))


def _sweep(segments: list[str], back: bool, tweak: str, key: bytes, hexadecimal: bool, inverse: bool, class_of: Callable[[str], object] | None = None) -> list[str]:
    """Each segment permuted under the given texts of those that come before it in this sweep."""
    out, given = list(segments), hashlib.blake2b(b"back" if back else b"forth", digest_size=16)
    for i in reversed(range(len(segments))) if back else range(len(segments)):
        out[i] = _respell_segment(segments[i], f"{tweak}|{given.hexdigest()}", key, hexadecimal, inverse, class_of)
        given.update((out[i] if inverse else segments[i]).encode() + b"|")
    return out


def respell(text: str, tweak: str, key: bytes, hexadecimal: bool = False, inverse: bool = False, class_of: Callable[[str], object] | None = None) -> str:
    """Letters and digits permuted together, each within its own alphabet; the rest stays. ``class_of`` tells texts of a
    segment apart that must not become each other."""
    if len(text) <= SEGMENT:
        return _respell_segment(text, tweak, key, hexadecimal, inverse, class_of)
    parts = [text[i : i + SEGMENT] for i in range(0, len(text), SEGMENT)]
    for back in (True, False) if inverse else (False, True):
        parts = _sweep(parts, back, tweak, key, hexadecimal, inverse, class_of)
    return "".join(parts)


def _relay(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def luhn(digits: str) -> int:
    """Sum of Luhn's test, 0 modulo 10 for a valid number."""
    back = digits.encode()[::-1]
    return sum(back[::2]) - 48 * len(back[::2]) + sum(back[1::2].translate(_DOUBLED))


def iban_rest(iban: str) -> int:
    return int((iban[4:] + iban[:4]).translate(_VALUES)) % 97


def _email(s: str, key: bytes, inverse: bool = False) -> str:
    """The address without its case is permuted; upper-case letters stay upper-case in their places."""
    host, _, top = s.rpartition(".")
    new = respell(host.lower(), "email", key, inverse=inverse)
    return f"{''.join(n.upper() if c.isupper() else n for c, n in zip(host, new, strict=True))}.{top}"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Where e-mail addresses begin and end."""
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _AFTER_AT.match(text, at + 1)):
            end = m.end()
            yield begin, end
        else:
            end = at + 1  # what stands before this @ is part of no other address
        at = text.find("@", end)


def _ip(s: str, key: bytes, inverse: bool = False) -> str | None:
    parts = s.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    value = 0
    for p in parts:
        value = value * 256 + int(p)
    value = permute(value, 1 << 32, "ip", key, None, inverse)
    return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))


def _card(s: str, key: bytes, inverse: bool = False) -> str | None:
    d = s.translate(_NOT_DIGIT)
    if len(d) < 13 or luhn(d) % 10 or d.count(d[0]) == len(d):
        return None
    n = len(d) - 2
    body = d[0] + str(permute(int(d[1:-1]), 10**n, f"card{d[0]}", key, None, inverse)).zfill(n)
    return _relay(s, body + str(-luhn(body + "0") % 10))


def _iban(s: str, key: bytes, inverse: bool = False) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    body = respell(plain[4:], "iban" + plain[:2], key, inverse=inverse)
    new = iter(f"{plain[:2]}{98 - iban_rest(plain[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def _phone(s: str, key: bytes, inverse: bool = False) -> str | None:
    d = s.translate(_NOT_DIGIT)
    lead, own = (d[:-10], d[-10:]) if len(d) == 10 or len(d) == 11 and d[0] == "1" else ("", "")
    if own and own[0] in "23456789" and own[3] in "23456789":
        area, exchange, line = int(own[:3]) - 200, int(own[3:6]) - 200, int(own[6:])
        value = permute((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, "nanp", key, None, inverse)
        rest, line = divmod(value, 10_000)
        return _relay(s, f"{lead}{rest // 800 + 200}{rest % 800 + 200}{line:04d}")
    if lead and s.startswith("+"):  # outside the numbering plan: permuted among those that are
        outside = lambda v: not (v // 10**9 > 1 and v // 10**6 % 10 > 1)
        return _relay(s, f"{lead}{permute(int(own), 10**10, 'outside nanp', key, outside, inverse):010d}")
    if not s.startswith("+") or not 9 <= len(d) <= 15 or d[0] in "01":
        return None
    n = len(d) - 2
    # ten digits that the numbering plan has no place for stay such, so that no two numbers meet
    unlike = (lambda v: not (d[0] in "23456789" and v // 10**6 % 10 > 1)) if n == 8 else None
    return _relay(s, d[:2] + str(permute(int(d[2:]), 10**n, f"phone{d[:2]}", key, unlike, inverse)).zfill(n))


def _ssn(s: str, key: bytes, inverse: bool = False) -> str | None:
    def fits(value: int) -> bool:
        area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    value = int(s.replace("-", ""))
    return _relay(s, f"{permute(value, 900_000_000, 'ssn', key, fits, inverse):09d}") if value < 900_000_000 and fits(value) else None


def _date(year: int, month: int, day: int, key: bytes, inverse: bool = False) -> date | None:
    """Permuted among the days of 1900 to 2099, or among those of the other years from 1000 on."""
    if not (1000 <= year and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    lo, hi = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()
    own = date(year, month, day).toordinal()
    if lo <= own < hi:
        return date.fromordinal(lo + permute(own - lo, hi - lo, "date", key, None, inverse))
    start, end = date(1000, 1, 1).toordinal(), date.max.toordinal() + 1
    return date.fromordinal(start + permute(own - start, end - start, "far date", key, lambda v: not lo <= start + v < hi, inverse))


def _iso(s: str, key: bytes, inverse: bool = False) -> str | None:
    d = _date(int(s[:4]), int(s[5:7]), int(s[8:]), key, inverse)
    return d and d.isoformat()


def _day(s: str, key: bytes, inverse: bool = False) -> str | None:
    """Day first where that is a date, else month first. A pseudonym that would be read otherwise when written
    month first is written day first."""
    first, sep, second, year = re.match(r"(\d+)(\D)(\d+)\D(\d+)", s).groups()
    width = 1 if any(len(x) == 1 for x in (first, second)) else 2
    write = lambda d, a, b: f"{a:0{width}d}{sep}{b:0{width}d}{sep}{d.year}"
    if d := _date(int(year), int(second), int(first), key, inverse):
        return write(d, d.day, d.month)
    if d := _date(int(year), int(first), int(second), key, inverse):
        return write(d, d.month, d.day) if d.day > 12 else write(d, d.day, d.month)
    return None


_BY_KIND = {"ip": _ip, "iso": _iso, "day": _day, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban}


def numbers(text: str, key: bytes = KEY, inverse: bool = False) -> list[tuple[int, int, str, str]]:
    """Valid finds that hold digits: (start, end, kind, pseudonym), first ones first."""
    finds, at = [], 0
    while m := _NUMERIC.search(text, at):
        kind, found, new = m.lastgroup if m.lastgroup != "sep" else "day", m[0], None
        while new is None and found:
            new = _BY_KIND[kind](found, key, inverse)
            cut = max(found.rfind(" "), found.rfind("-")) if kind == "card" else found.rfind(" ") if kind == "iban" else -1
            if new is None:  # a card may be followed by other numbers, an IBAN by capital words
                found = found[:cut] if cut >= 13 else ""
        if new:
            finds.append((m.start(), m.start() + len(found), kind, new))
        # what fails its validation may hold a valid find that starts after its first run of digits
        at = m.start() + len(found) if new else _RUN.match(text, m.start()).end()
    return finds


def _hexadecimal(text: str) -> bool:
    return bool(_HEXADECIMAL.fullmatch(text))


def _class_of(text: str) -> tuple[bool, bool]:
    """Texts of a secret that must not become each other: hexadecimal or not, with a valid find or without."""
    return _hexadecimal(text), bool(_DIGIT.search(text) and numbers(text))


def secret(value: str, key: bytes = KEY, inverse: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The pseudonym of a named secret, and the finds of other kinds in it."""
    finds = numbers(value, key, inverse) if _DIGIT.search(value) else []
    rest = list(value)
    for start, end, _, _ in finds:
        rest[start:end] = "\0" * (end - start)
    rest = "".join(rest)
    out = list(respell(rest, "secret", key, _hexadecimal(rest), inverse, _class_of) if rest.strip("\0") else rest)
    for start, end, _, new in finds:
        out[start:end] = new
    return "".join(out), [f[:3] for f in finds]


def pseudonymise(text: str | None, key: bytes = KEY, inverse: bool = False) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with every valid find replaced, and the finds (start, end, kind) in the given text. ``inverse`` gives back the
    text of which a text of pseudonyms was made, but for the layout of dates written month first."""
    if not text:
        return text, []
    finds: list[tuple[int, int, str, str]] = []
    if "@" in text:
        finds += [(a, b, "email", _email(text[a:b], key, inverse)) for a, b in emails(text)]
    if _DIGIT.search(text):
        finds += numbers(text, key, inverse)
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            new, inside = secret(m[1], key, inverse)
            whole = [k for a, b, k in inside if (a, b) == (0, len(m[1]))]
            finds.append((*m.span(1), whole[0] if whole else "secret", new))
    out, last, kept = [], 0, []
    for start, end, kind, new in sorted(finds, key=lambda f: (f[0], -f[1])):
        if start >= last:
            out += [text[last:start], new]
            last = end
            kept.append((start, end, kind))
    return "".join([*out, text[last:]]), kept


def pseudonyms(docs: DataFrame, key: bytes = KEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (with pseudonyms), n_found, kinds (JSON counts by kind), spans (in the given text),
    and the columns of ``keep``."""
    fields = [docs.schema[c] for c in keep if c not in ("doc_id", "text")]
    schema = ", ".join(["doc_id string", "text string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_found int", "kinds string", "spans array<struct<start:int,end:int,kind:string>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [pseudonymise(t, key) for t in batch["text"]]
            yield batch.assign(
                text=[t for t, _ in done],
                n_found=[len(s) for _, s in done],
                kinds=[json.dumps(dict(sorted(Counter(k for *_, k in s).items()))) for _, s in done],
                spans=[[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done],
            )

    arrow_rows(docs.sparkSession)
    return ids_as_long(ids_as_text(docs, "text", *[f.name for f in fields]).mapInPandas(run, schema))
