"""Operator 10: personal data under format-preserving Feistel pseudonyms.

Numbers and dates are recognised by pattern and validated (Luhn and mod-97 check digits, calendar, numbering plans), then
permuted within their own format by a keyed Feistel network: a card number becomes another valid card number, a date another
date of its century, and equal values get equal pseudonyms in every document, whatever their separators. The network works on
mixed radices, so the letters and digits of an e-mail's local part are permuted by it as well. Where the permutation leaves
the valid values it is applied again until it is back (cycle walking), which keeps it one-to-one.

Null texts stay null, empty ones empty; whole texts are read. Overlapping findings: the kind first in ``KINDS`` wins, then the
leftmost. Repeated rows are treated alike. Whoever holds the key can invert the permutation; it is a parameter.
"""
from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable
from datetime import date
from hashlib import blake2b
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.common import in_batches

ROUNDS = 8
KINDS = ("email", "iban", "ip", "card", "ssn", "date", "phone")

NUMBERS = re.compile(r"[+(]?\d[\d().\-/ ]{4,}\d")  # stretches in which the numeric kinds can stand
EMAIL = re.compile(r"(?<![\w.+-])([A-Za-z0-9_.+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![\w-])")
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}")
IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
CARD = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
DATE = re.compile(r"(?<![\d./-])(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))(?![\d/-])")
PHONE = re.compile(r"(?<![\d.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\d-])")
E164 = re.compile(r"(?<![\w+.-])\+[1-9]\d{6,14}(?![\d-])")
PLAIN = re.compile(r"(?<![\w+.,/-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|[.,]\d)")  # ten digits of the North American plan
PAIRS = re.compile(r"(?<![\d.,/+-])(?<!\d[ .-])(?:\+\d{1,3}[ .-]?\d{1,3}|0\d{1,3})([ .-])\d{2,3}(?:\1\d{2}){2,4}(?!\d|-|\1\d)")
SPAN = re.compile(r"[\w -]+")
#: Characters of an IBAN by country.
IBAN_SIZES = {c: int(n) for n, of in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FO,FI,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,TL,SO "
    "24:AD,CZ,DZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:AO,CV,LY,MZ,PT,ST 26:IR,IS,TR 27:CF,CG,CM,DJ,FR,GA,GQ,GR,IT,KM,MC,MG,SM,TD,BI "
    "28:AL,AZ,BF,BJ,BY,CI,CY,DO,GT,HN,HU,LB,MA,ML,NE,NI,PL,SN,SV,TG 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in of.split(",")}
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def permute(values: list[int], radices: list[int], key: bytes, tweak: str, inverse: bool = False) -> list[int]:
    """A keyed one-to-one map of the mixed-radix numbers: the two halves are added to in turn, modulo their own range."""
    cut = (len(values) + 1) // 2
    sides = [(values[:cut], radices[:cut]), (values[cut:], radices[cut:])]

    def number(v: list[int], r: list[int]) -> int:
        n = 0
        for x, base in zip(v, r, strict=True):
            n = n * base + x
        return n

    halves, ranges = [number(*s) for s in sides], [prod(s[1]) for s in sides]
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        own, other = i % 2, 1 - i % 2
        mixed = blake2b(f"{tweak}|{ranges}|{i}|{halves[other]}".encode(), key=key, digest_size=64).digest()
        add = int.from_bytes(mixed, "big") % ranges[own]
        halves[own] = (halves[own] - add if inverse else halves[own] + add) % ranges[own]
    out = []
    for n, (_, r) in zip(halves, sides, strict=True):
        digits = []
        for base in reversed(r):
            n, x = divmod(n, base)
            digits.append(x)
        out += digits[::-1]
    return out


def walk(values: list[int], radices: list[int], key: bytes, tweak: str, valid: Callable[[list[int]], bool]) -> list[int]:
    while True:
        values = permute(values, radices, key, tweak)
        if valid(values):
            return values


def luhn_check(payload: list[int]) -> int:
    """The check digit to put behind the payload."""
    doubled = [x if i % 2 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(payload))]
    return -sum(doubled) % 10


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def put_back(pattern: str, symbols: list[str]) -> str:
    """``pattern`` with its letters and digits replaced in order."""
    left = iter(symbols)
    return "".join(next(left) if c.isalnum() else c for c in pattern)


def digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def email(m: re.Match, key: bytes) -> str | None:
    local = m[1]
    alnum = [c for c in local if c.isalnum()]
    if not alnum:
        return None
    bases = [10 if c.isdigit() else 26 for c in alnum]
    values = [int(c) if c.isdigit() else ord(c.lower()) - 97 for c in alnum]
    out = permute(values, bases, key, "email@" + m[2].lower())
    made = [str(x) if c.isdigit() else chr(x + (65 if c.isupper() else 97)) for x, c in zip(out, alnum, strict=True)]
    return put_back(local, made) + "@" + m[2]


def iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = plain[4:]
    bases = [10 if c.isdigit() else 26 for c in body]
    out = permute([int(c) if c.isdigit() else ord(c) - 65 for c in body], bases, key, "iban" + plain[:2])
    made = "".join(str(x) if c.isdigit() else chr(x + 65) for x, c in zip(out, body, strict=True))
    check = 98 - mod97(made + plain[:2] + "00")
    return put_back(m[0], list(f"{plain[:2]}{check:02d}{made}"))


def public(octets: list[int]) -> bool:
    return 1 <= octets[0] <= 223 and octets[0] not in (10, 127)


def ip(m: re.Match, key: bytes) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255 or not public(octets):
        return None
    return ".".join(map(str, walk(octets, [256] * 4, key, "ip", public)))


def card(m: re.Match, key: bytes) -> str | None:
    plain = digits(m[0])
    if luhn_check(plain[:-1]) != plain[-1] or not any(plain):
        return None
    payload = plain[:1] + permute(plain[1:-1], [10] * (len(plain) - 2), key, f"card{plain[0]}")  # the first digit tells the kind of card
    return put_back(m[0], [str(x) for x in [*payload, luhn_check(payload)]])


def ssn_valid(d: list[int]) -> bool:
    area = d[0] * 100 + d[1] * 10 + d[2]
    return area not in (0, 666) and area < 900 and any(d[3:5]) and any(d[5:])


def ssn(m: re.Match, key: bytes) -> str | None:
    plain = digits(m[0])
    return put_back(m[0], [str(x) for x in walk(plain, [10] * 9, key, "ssn", ssn_valid)]) if ssn_valid(plain) else None


def calendar(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def dated(m: re.Match, key: bytes) -> str | None:
    """Year first, or day and month first; with slashes the month leads where that is a date. Days and months are written
    with two digits, or as short as they are if one of the given ones has a single digit."""
    if m[1]:
        order, parts = "ymd", (m[1], m[3], m[4])
    else:
        parts = (m[5], m[7], m[8])
        order = "mdy" if m[6] == "/" and calendar(int(parts[2]), int(parts[0]), int(parts[1])) else "dmy"
    of = {k: int(x) for k, x in zip(order, parts, strict=True)}
    day = calendar(of["y"], of["m"], of["d"])
    if day is None:
        return None
    first = date(max(1, day.year // 100 * 100), 1, 1)
    span = date(day.year // 100 * 100 + 99, 12, 31).toordinal() - first.toordinal() + 1
    side = int(span ** 0.5) + 1
    n = day.toordinal() - first.toordinal()
    out = walk([n // side, n % side], [side, side], key, f"date{first.year}", lambda v: v[0] * side + v[1] < span)
    new = date.fromordinal(first.toordinal() + out[0] * side + out[1])
    digits = 1 if any(len(x) == 1 for k, x in zip(order, parts, strict=True) if k != "y") else 2
    wide = {"y": f"{new.year:04d}", "m": f"{new.month:0{digits}d}", "d": f"{new.day:0{digits}d}"}
    mark = m[2] or m[6]
    return mark.join(wide[k] for k in order)


def phone(m: re.Match, key: bytes) -> str | None:
    """The country code stays; North American numbers stay within their plan."""
    lead = re.match(r"\+\d{1,3}(?=[ .(-])", m[0])
    prefix = lead[0] if lead else m[0][:2 if m[0][1] in "17" else 3 if m[0][1:3] in TWO else 4] if m[0][0] == "+" else ""
    rest = m[0][len(prefix):]
    plain = digits(rest)
    if not (4 if prefix else 7) <= len(plain) <= 14:
        return None
    plan = len(plain) == 10 and prefix in ("", "+1") and plain[0] > 1 and plain[3] > 1
    valid = (lambda v: v[0] > 1 and v[3] > 1) if plan else (lambda v: True)
    return prefix + put_back(rest, [str(x) for x in walk(plain, [10] * len(plain), key, "phone" + prefix, valid)])


def paired(m: re.Match, key: bytes) -> str | None:
    """A phone in groups of two digits; shorter ones without a country code may be anything."""
    return phone(m, key) if m[0][0] == "+" or len(digits(m[0])) >= 9 else None


def iban_ends(m: re.Match, fresh: bool) -> list[int]:
    """Ends to try, the likeliest first: where the country's length is reached, else (other countries: all) the ends of words."""
    text, ends, n = m.string, [], 0
    wanted = IBAN_SIZES.get(m[0][:2])
    first = []
    for i in range(m.start(), m.end()):
        n += text[i] != " "
        if n >= 15 and text[i] != " " and not re.match("[A-Z0-9]", text[i + 1:i + 2]):
            (first if n == wanted else ends).append(i + 1)
    return first + (ends[-1:] if wanted else ends[::-1])


def card_ends(m: re.Match, fresh: bool) -> list[int]:
    """Every end of 13 to 19 digits before a separator: first that of the issuer's usual length, then the longest. Within a longer row of
    numbers only groups of three digits or more (the last may be shorter) that begin as payment cards do."""
    text, ends, n = m.string, [], 0
    usual = 15 if re.match("3[47]", m[0].replace(" ", "").replace("-", "")) else 14 if m[0][:2] in ("30", "36", "38") else 16
    for i in range(m.start(), m.end()):
        n += text[i].isdigit()
        if n < 13 or not text[i].isdigit() or text[i + 1:i + 2].isdigit():
            continue
        groups = re.split("[ -]", text[m.start():i + 1])
        if fresh and i + 1 == m.end() or m[0][0] in "23456" and all(len(g) > 2 for g in groups[:-1]):
            ends.append((n != usual, -n, i + 1))
    return [x[-1] for x in sorted(ends)]


def checked(pattern: re.Pattern, ends: Callable, rule: Callable, text: str, key: bytes, start: int, stop: int):
    """(start, end, pseudonym) of values with check digits: from each start the first end that passes. The search goes on behind a
    value, and where none passed behind the start."""
    at = behind = start
    while m := pattern.search(text, at, stop):
        at = m.start() + 1
        for end in ends(m, m.start() >= behind):
            new = rule(SPAN.match(text, m.start(), end), key)
            if new is not None:
                yield m.start(), end, new
                at = behind = end
                break
        else:
            behind = max(behind, m.end())


RULES = (("ip", IP, ip), ("ssn", SSN, ssn), ("date", DATE, dated), ("phone", PHONE, phone), ("phone", E164, phone), ("phone", PLAIN, phone),
         ("phone", PAIRS, paired))


def findings(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym), not overlapping, in order."""
    found: list[tuple[int, int, int, str]] = []

    def add(kind: str, rule: Callable, matches) -> None:
        for m in matches:
            new = rule(m, key)
            if new is not None:
                found.append((KINDS.index(kind), m.start(), m.end(), new))

    if "@" in text:
        add("email", email, EMAIL.finditer(text))
    found += [(KINDS.index("iban"), *x) for x in checked(IBAN, iban_ends, iban, text, key, 0, len(text))]
    for stretch in NUMBERS.finditer(text):
        found += [(KINDS.index("card"), *x) for x in checked(CARD, card_ends, card, text, key, stretch.start(), stretch.end())]
        for kind, pattern, rule in RULES:
            add(kind, rule, pattern.finditer(text, stretch.start(), stretch.end()))
    taken: list[tuple[int, int, str, str]] = []
    starts: list[tuple[int, int]] = []
    for kind, start, end, new in sorted(found, key=lambda f: (f[0], f[1], -f[2])):
        at = bisect_left(starts, (end, -1))
        if at and starts[at - 1][1] > start:
            continue
        insort(starts, (start, end))
        taken.append((start, end, KINDS[kind], new))
    return sorted(taken)


def pseudonymised(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    if not text:
        return text, []
    spans = findings(text, key)
    out, at = [], 0
    for start, end, _, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]) if spans else text, [(s, e, k) for s, e, k, _ in spans]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "private") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, plus ``spans``: (kind, start, end) in the text as it was, in order."""
    keep = [c for c in docs.columns if c != spans]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(spans, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [pseudonymised(t, key) for t in batch.column(text).to_pylist()]
        new = pa.array([r[0] for r in rows], pa.string())
        where = pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in r[1]] for r in rows], kind)
        return pa.RecordBatch.from_arrays([*(new if c == text else batch.column(c) for c in keep), where], names=[*keep, spans])

    return docs.mapInArrow(in_batches(run), schema)
