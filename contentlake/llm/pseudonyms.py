"""Format-preserving pseudonyms for personal data (operator 6).

Found values are replaced by keyed permutations of themselves within their own format, so equal
values get equal pseudonyms in every document, separators and lengths stay (but for the parts of an
IP address, which are numbers), and nothing has to be looked up or shared between tasks. A value's characters are digits of a mixed radix (10 for a digit,
26 for a letter, 16 for a digit or letter of a hex string, and so on); the digits are cut into two
halves, and ten rounds of an alternating Feistel network add a keyed hash of one half to the other.

What counts as a value is validated first: card numbers by their check digit, addresses by the range
of their parts, dates by the calendar, telephone numbers by their shape and digit count, bank
account numbers by their remainder. Card and account numbers get their check digits anew, so a valid
number stays valid; dates stay dates between 1900 and 2099 that are written alike (cycle walking); social security
numbers are permuted among the valid areas, groups and serials; e-mail addresses keep
their shape and last label; keys and passwords keep their prefixes. Letters stay in their block of letters
(``BLOCKS``); those of other blocks stay as they are.

Every pattern takes time linear in the text. Not looked for: telephone numbers without any separator
or leading plus, dates in words, names.

Where a card or account number may run on into a number or word beside it, its shorter forms are
tried too, and then every later start. A row of digit groups that is no card number may pass the
check digit in one of these forms by chance, and is then replaced. The permutation of each value can
be inverted; ``back`` finds the values of a text anew, and may cut such a row differently.

Defined results: a null text stays null, a text without values is unchanged. Rows repeat as given.
Added columns never replace a column of the input. A single-character value cannot be hidden by a
permutation of its format; no pattern here accepts one.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date", "secret")


def _number(digits: list[int], radices: list[int]) -> tuple[int, int]:
    n, size = 0, 1
    for d, r in zip(digits, radices, strict=True):
        n, size = n * r + d, size * r
    return n, size


def _digits(n: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        n, d = divmod(n, r)
        out.append(d)
    return out[::-1]


def permute(digits: list[int], radices: list[int], key: bytes, kind: str, back: bool = False) -> list[int]:
    """Keyed permutation of the mixed-radix numbers of one format; ``back`` inverts it."""
    h = len(radices) // 2
    (a, size_a), (b, size_b) = _number(digits[:h], radices[:h]), _number(digits[h:], radices[h:])
    tweak = f"{kind}:{','.join(map(str, radices))}".encode()
    wide = (max(size_a, size_b).bit_length() + 7) // 8 + 1

    def noise(i: int, half: int, size: int) -> int:
        out, block = b"", 0
        while len(out) < wide + 8:
            out += blake2b(b"%d|%d|" % (i, block) + tweak + half.to_bytes(wide, "big"), key=key).digest()
            block += 1
        return int.from_bytes(out[:wide + 8], "big") % size

    for i in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
        sign = -1 if back else 1
        if i % 2:
            a = (a + sign * noise(i, b, size_b)) % size_a if size_a > 1 else a
        else:
            b = (b + sign * noise(i, a, size_a)) % size_b
    return _digits(a, radices[:h]) + _digits(b, radices[h:])


_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: First and last code points of digits and of the letters of one case or script.
BLOCKS = tuple(range(a, b + 1) for a, b in (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1),
    (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA), (0x620, 0x63F), (0x641, 0x64A), (0x3041, 0x3096),
    (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)))


#: Longer values are permuted by parts of as many characters, each in its own way: big numbers take quadratic time.
PART = 256


def permute_text(value: str, key: bytes, kind: str, alphabet: str | None = None, back: bool = False) -> str:
    """Permutes a string: digits stay digits, letters stay letters of their block (or, with an
    ``alphabet``, all of its characters mix); other characters stay where they are."""
    mixed = [ord(c) for c in alphabet or ""]
    block = {c: mixed if ord(c) in mixed else next((s for s in BLOCKS if ord(c) in s), None) for c in set(value)}
    sets = [block[c] for c in value]
    at = [i for i, s in enumerate(sets) if s]
    new = []
    for a in range(0, len(at), PART):
        part = at[a:a + PART]
        new += permute([sets[i].index(ord(value[i])) for i in part], [len(sets[i]) for i in part], key, f"{kind}{a or ''}", back)
    out = list(value)
    for i, d in zip(at, new, strict=True):
        out[i] = chr(sets[i][d])
    return "".join(out)


def luhn_digit(body: list[int]) -> int:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(body)))
    return -total % 10


def _onto(pattern: str, digits: list[int]) -> str:
    left = iter(digits)
    return "".join(str(next(left)) if c in _DIGITS else c for c in pattern)


def card(value: str, key: bytes, back: bool = False) -> str | None:
    d = [int(c) for c in value if c in _DIGITS]
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    new = permute(d[:-1], [10] * (len(d) - 1), key, "card", back)
    return _onto(value, [*new, luhn_digit(new)])


def ip(value: str, key: bytes, back: bool = False) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, permute([int(p) for p in parts], [256] * 4, key, "ip", back)))


def ip6(value: str, key: bytes, back: bool = False) -> str | None:
    """At least five hex digits; letters of both cases become small ones."""
    if sum(c != ":" for c in value) < 5:
        return None
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    large = value == value.upper() and value != value.lower()
    new = permute_text(value.lower(), key, "ip6", "0123456789abcdef", back)
    return new.upper() if large else new


def phone(value: str, key: bytes, back: bool = False) -> str | None:
    head = re.match(r"\+\d{1,3}(?=[\s(.-])", value)
    head = head.group(0) if head else ""
    d = [int(c) for c in value[len(head):] if c in _DIGITS]
    if not 7 <= len(d) <= 14:
        return None
    return head + _onto(value[len(head):], permute(d, [10] * len(d), key, "phone", back))


def ssn(value: str, key: bytes, back: bool = False) -> str | None:
    """Numbered by valid area (1 to 899 without 666), group (1 to 99) and serial (1 to 9999)."""
    area, group, serial = (int(p) for p in value.split("-"))
    area, group, serial = permute([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn", back)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(value: str, key: bytes, back: bool = False) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = permute_text(plain[4:], key, "iban", back=back)
    full = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(full) for c in value)


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
_YEAR_FIRST = re.compile(r"(\d{4})([-/])(\d\d)\2(\d\d)")
_YEAR_LAST = re.compile(r"(\d\d?)([./-])(\d\d?)\2(\d{4})")


def date(value: str, key: bytes, back: bool = False) -> str | None:
    """Year first, or day or month first; a part written with one digit keeps one."""
    if m := _YEAR_FIRST.fullmatch(value):
        (year, sep, month, day), swapped = m.groups(), False
    elif m := _YEAR_LAST.fullmatch(value):
        day, sep, month, year = m.groups()
        if swapped := int(month) > 12:  # month before day
            day, month = month, day
    else:
        return None
    try:
        n = dt.date(int(year), int(month), int(day)).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    while True:  # walk until the number is a day of the range that is written alike, and whose order is as clear
        n = _number(permute(_digits(n, [300, 300]), [300, 300], key, "date" + ("s" if swapped else ""), back), [300, 300])[0]
        if n < _DAYS:
            new = dt.date.fromordinal(n + _FIRST)
            if (not swapped or new.day > 12) and len(str(new.day)) <= len(day) and len(str(new.month)) <= len(month):
                break
    y, mo, d = f"{new.year:04d}", f"{new.month:0{len(month)}d}", f"{new.day:0{len(day)}d}"
    return sep.join((y, mo, d) if value.startswith(year + sep) else (mo, d, y) if swapped else (d, mo, y))


def email(value: str, key: bytes, back: bool = False) -> str | None:
    keep = value.rindex(".")
    return permute_text(value[:keep], key, "email", back=back) + value[keep:]


def secret(value: str, key: bytes, back: bool = False) -> str | None:
    m = re.match(r"(?i)(AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|(?:api[_-]?key|token|passw(?:or)?d|secret)\s*[=:]\s*[\"']?)(.+)", value, re.DOTALL)
    head, body = m.groups()
    alphabet = None
    if re.fullmatch(r"[0-9a-f]+", body):
        alphabet = "0123456789abcdef"
    elif re.fullmatch(r"[0-9A-Z]+", body):
        alphabet = _DIGITS + _UPPER
    return head + permute_text(body, key, "secret", alphabet, back)


#: Digit groups in which card numbers are written: these are looked for first, so that a date, code or
#: other number beside a card is not taken for a part of it.
_CARD_GROUPS = ({(n,) for n in range(13, 20)} | {(4, 4, 4, n) for n in range(1, 5)} | {(4, 4, 4, 4, n) for n in range(1, 4)}
                | {(4, 6, 5), (4, 6, 4), (4, 5, 6), (4, 4, 5), (6, 13), (8, 8)})


_GROUP = re.compile(r"[0-9]+")
#: Up to 19 whole groups of digits from the start of one, if they have 13 digits at least.
_CARD = r"(?<![\d.])(?=\d(?:[ -]?\d){12})\d{1,19}(?!\d)(?:[ -]\d{1,19}(?!\d)){0,18}"


def _card_runs(m: re.Match, usual: bool) -> Iterator[tuple[int, int]]:
    """First groups of the match with 13 to 19 digits, the longest first: those in the groups of a card
    number, or all others that no hyphen joins to a number or word."""
    a, sizes, found = m.start(), (), []
    for g in _GROUP.finditer(m.string, a, m.end()):
        b = g.end()
        sizes += (b - g.start(),)
        if sum(sizes) > 19:
            break
        if sum(sizes) >= 13 and (sizes in _CARD_GROUPS) == usual and (usual or "-" not in (m.string[a - 1:a], m.string[b:b + 1])):
            found.append((a, b))
    return reversed(found)


def _card_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    return _card_runs(m, True)


def _other_card_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    return _card_runs(m, False)


_IBAN = r"\b[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"


#: Length of the account numbers of each country (ISO 13616).
_IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}


def _iban_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    """The match, then its prefixes of the same form that end before a blank, the longest first."""
    a, b = m.span()
    while b > a:
        if m.re.fullmatch(m.string, a, b):
            yield a, b
        b = m.string.rfind(" ", a, b)


def _national_iban_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    """Those of its country's length: a number or word beside an account is not taken for a part of it."""
    n = _IBAN_LENGTHS.get(m.group(0)[:2])
    return ((a, b) for a, b in _iban_spans(m) if n == b - a - m.string.count(" ", a, b))


def _whole(m: re.Match) -> Iterator[tuple[int, int]]:
    yield m.span()


def _email_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    """From the first letter or digit of the local part, if it has one."""
    at = next((i for i in range(m.start(), m.string.index("@", m.start())) if m.string[i].isalnum()), None)
    return iter(() if at is None else ((at, m.end()),))


#: Kind, pattern, pseudonym, and the spans of a match that may be values in order of preference. Order
#: matters: a span taken by an earlier entry is not looked at again.
PATTERNS: tuple[tuple[str, str, Callable[..., str | None], Callable[[re.Match], Iterator[tuple[int, int]]]], ...] = (
    ("secret", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:gh[pousr]_|sk-|xox[abprs]-)[0-9A-Za-z-]{16,}"
               r"|(?i:\b(?:api[_-]?key|token|passw(?:or)?d|secret)\s*[=:]\s*[\"']?)[0-9A-Za-z+/_-]{8,}", secret, _whole),
    # Whole runs of a local part's characters, each looked at once; letters of all scripts.
    ("email", r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]++\.)+[A-Za-z]{2,}+", email, _email_spans),
    ("iban", _IBAN, iban, _national_iban_spans),
    ("iban", _IBAN, iban, _iban_spans),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", ip, _whole),
    ("ip", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", ip6, _whole),
    ("date", r"(?<!\d)(?:\d{4}([-/])\d\d\1\d\d|\d\d?([./-])\d\d?\2\d{4})(?!\d)", date, _whole),
    ("card", _CARD, card, _card_spans),
    ("card", _CARD, card, _other_card_spans),
    ("ssn", r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])", ssn, _whole),
    ("phone", r"(?<![\w.+-])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]?\d{3,4}(?![\w-])"
              r"|(?<![\w+])\+\d{8,14}(?!\d)", phone, _whole),
)
#: Kinds searched on behind every match, whose length has no bound; others from the next start if the match is no value.
BEHIND = ("secret", "email")
#: No pattern of a kind fits a text without this (a test holds the patterns' shortest matches against it).
HINTS = {"secret": r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|(?i:passw|token|secret|api[_-]?key)", "email": "@", "ip": r"\d\.\d|:[0-9A-Fa-f]{0,4}:",
         "date": r"\d[./-]\d"} | dict.fromkeys(("iban", "card", "ssn", "phone"), r"\d\d")


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.key = key
        self.hints = {kind: re.compile(p, re.ASCII) for kind, p in HINTS.items()}
        self.patterns = [(kind, re.compile(p, 0 if kind == "email" else re.ASCII), f, cut) for kind, p, f, cut in PATTERNS]

    def __call__(self, text: str | None, back: bool = False) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and the spans (start, end, kind) of the values."""
        if not text:
            return text, []
        kinds = {kind for kind, hint in self.hints.items() if hint.search(text)}
        spans: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(text))
        for kind, pattern, make, cut in self.patterns:
            if kind not in kinds:
                continue
            at = 0
            while m := pattern.search(text, at):
                at = m.end() if kind in BEHIND else m.start() + 1
                for a, b in cut(m):
                    if 1 in taken[a:b]:
                        continue
                    new = make(text[a:b], self.key, back)
                    if new is not None:
                        spans.append((a, b, kind, new))
                        taken[a:b] = b"\1" * (b - a)
                        at = max(at, b)
        spans.sort()
        out, last = [], 0
        for a, b, _, new in spans:
            out += [text[last:a], new]
            last = b
        return "".join([*out, text[last:]]), [s[:3] for s in spans]


FOUND = "struct<text: string, spans: array<struct<first: int, last: int, kind: string>>>"


def replace(text: Column, key: bytes) -> Column:
    """struct(text, spans) of each text."""
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string())]))
    state: list[Pseudonymizer] = []

    def apply(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(Pseudonymizer(key))
        done = [state[0](t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                           pa.array([[dict(zip(("first", "last", "kind"), s, strict=True)) for s in d[1]] for d in done], spans)],
                                          names=["text", "spans"])

    apply.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, FOUND)(text)


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with pseudonyms in ``text`` and one more column (its name is returned): the spans."""
    name = free_name(docs, "pii")
    rows = docs.withColumn(name, replace(F.col(text), key))
    return rows.select(*[F.col(f"{name}.text").alias(c) if c == text else F.col(c) for c in docs.columns],
                       F.col(f"{name}.spans").alias(name)), name
