"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Patterns propose numbers and dates; each kind's check decides whether the match is one (a card's
check digit, a calendar date, octets up to 255, the rules of telephone and social security numbers,
an account's check digits). What passes is mapped to its rank among all valid values of the same
format, the rank is permuted by a Feistel network keyed for that format, and the permuted rank is
written in the same format: digits stay digits, separators and prefixes stay, a check digit is
computed anew. A permutation never maps two values to one, and equal values (whatever their
separators) get equal pseudonyms in all documents, so links stay. The holder of the key can invert
it. Names before an @ are permuted among names of the same pattern of letters and digits.

A card or account may be followed by further digits or capitals (a security code, an expiry date, a
word): when the longest reading fails its check, shorter ones that end where a run of letters and
digits ends are tried, and a match that fails altogether does not hide one that starts inside it.
A run of digits is not cut in its middle. Reading a pseudonym together with what follows it may
pass by chance (a card's check: 1 in 10); the spans in ``kinds`` tell then what was replaced.

A Feistel network works on 2w bits; a value that leaves the range is permuted again until it is
back (cycle walking), which keeps it a permutation of the range. Only documents are read: one pass,
no shuffle. Overlapping matches go to the one that begins first, then to the order of KINDS.

Defined results: a null text stays null with no finds; the text outside the finds does not change;
rows with null or repeated ids are treated each on its own. A find that nothing else shares its
format with (a range of one value) is left as it is, because there is no other value.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, rows_of

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
PSEUDONYMS_HELD = 100_000
SCHEMA = "doc_id long, text string, n_found long, kinds string"


@functools.lru_cache(1 << 16)
def _round(key: bytes, purpose: bytes, turn: int, half: int, width: int) -> int:
    digest = hashlib.blake2b(half.to_bytes((width + 7) // 8, "big") + bytes([turn]), key=key, person=purpose, digest_size=64).digest()
    return int.from_bytes(digest, "big") & ((1 << width) - 1)


def permute(rank: int, size: int, key: bytes, purpose: str, inverse: bool = False) -> int:
    """The keyed permutation of 0 .. size - 1 for one format."""
    if size <= 1:
        return rank
    width = (max(2, (size - 1).bit_length()) + 1) // 2
    person = hashlib.blake2b(f"{purpose} {size}".encode(), digest_size=16).digest()
    mask = (1 << width) - 1
    while True:
        left, right = rank >> width, rank & mask
        for turn in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round(key, person, turn, left, width), left
            else:
                left, right = right, left ^ _round(key, person, turn, right, width)
        rank = left << width | right
        if rank < size:
            return rank


def luhn(digits: str) -> int:
    """The check digit that completes the digits."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += (d * 2 - 9 * (d > 4)) if k % 2 == 0 else d
    return -total % 10


def refill(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in pattern)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


# Each kind maps a match to (rank, size, write), where write turns a rank into text, or to None when the check fails.
Ranked = tuple[int, int, Callable[[int], str]] | None


def card(text: str) -> Ranked:
    """13 to 19 digits with a valid check digit; the first digit (the network) stays."""
    digits = only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2

    def write(rank: int) -> str:
        body = digits[0] + str(rank).zfill(n)
        return refill(text, body + str(luhn(body)))

    return int(digits[1:-1]), 10**n, write


def ip(text: str) -> Ranked:
    """Four octets. First octets that are not public (0, 10, 127, from 224 on) change among themselves; only 127.0.0.1 stays."""
    octets = [int(x) for x in text.split(".")]
    if any(x > 255 for x in octets) or octets == [127, 0, 0, 1]:
        return None
    public = lambda x: 0 < x < 224 and x not in (10, 127)
    heads = [x for x in range(256) if public(x) == public(octets[0])]
    size = len(heads) << 24
    # ranks from that of 127.0.0.1 on are one less
    left_out = size if public(octets[0]) else heads.index(127) << 24 | 1
    rank = heads.index(octets[0]) << 24 | octets[1] << 16 | octets[2] << 8 | octets[3]

    def write(r: int) -> str:
        r += r >= left_out
        return f"{heads[r >> 24]}.{r >> 16 & 255}.{r >> 8 & 255}.{r & 255}"

    return rank - (rank > left_out), size - (left_out < size), write


def _codes(code: str) -> tuple[str, int, int]:
    """The class of a three-digit code, its first code and size: from 200 on they are assigned, below they are not."""
    return ("low", 0, 200) if code < "200" else ("high", 200, 800)


def phone(text: str) -> Ranked:
    """Ten digits after the country code 1. Area and exchange stay below 200 or from 200 on, the fictional exchange 555 stays.

    Codes below 200 are none that are assigned: bare groups of digits with them are no number, but
    with a country code or an area in brackets they are.
    """
    digits = only_digits(text)
    code, national = digits[:-10], digits[-10:]
    _, area_from, areas = _codes(national[:3])
    exchange_class, exchange_from, exchanges = _codes(national[3:6])
    if code not in ("", "1") or "low" in (_codes(national[:3])[0], exchange_class) and not (code or "(" in text):
        return None
    area, exchange, line = int(national[:3]) - area_from, int(national[3:6]) - exchange_from, int(national[6:])
    if national[3:6] == "555":
        exchange, exchange_from, exchanges = 0, 555, 1
    elif exchange_class == "high":
        # 555 is a class of its own
        exchange, exchanges = exchange - (exchange > 355), 799
    skip = exchanges == 799

    def write(r: int) -> str:
        rest, line_ = divmod(r, 10**4)
        area_, exchange_ = divmod(rest, exchanges)
        exchange_ += skip and exchange_ >= 355
        return refill(text, f"{code}{area_ + area_from:03d}{exchange_ + exchange_from:03d}{line_:04d}")

    return (area * exchanges + exchange) * 10**4 + line, areas * exchanges * 10**4, write


def phone_format(text: str) -> str:
    national = only_digits(text)[-10:]
    return " ".join((_codes(national[:3])[0], "555" if national[3:6] == "555" else _codes(national[3:6])[0]))


#: Country codes of one and of two digits; all others have three.
_SHORT_CODES = {"7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def country(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in _SHORT_CODES), digits[:3])


def phone_abroad(text: str) -> Ranked:
    """8 to 15 digits after a plus; the country code stays. After +1 the rule of ten digits holds."""
    digits = only_digits(text)
    if digits[0] == "1":
        return phone(text)
    if not 8 <= len(digits) <= 15:
        return None
    code = country(digits)
    n = len(digits) - len(code)
    return int(digits[len(code) :]), 10**n, lambda r: refill(text, code + str(r).zfill(n))


def abroad_format(text: str) -> str:
    digits = only_digits(text)
    return phone_format(text) if digits[0] == "1" else f"+{country(digits)} {len(digits)}"


def social(text: str) -> Ranked:
    """AAA-GG-SSSS with an area that is not 000, 666 or from 900 on, and no part of zeros."""
    area, group, serial = (int(x) for x in re.split(r"[- ]", text))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    rank = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1

    def write(r: int) -> str:
        serial_, rest = r % 9999 + 1, r // 9999
        return refill(text, f"{areas[rest // 99]:03d}{rest % 99 + 1:02d}{serial_:04d}")

    return rank, len(areas) * 99 * 9999, write


def iban(text: str) -> Ranked:
    """An account number whose remainder modulo 97 is 1; country, bank letters and grouping stay."""
    plain = text.replace(" ", "")
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    digits = only_digits(body)

    def write(r: int) -> str:
        new = refill(body, str(r).zfill(len(digits)))
        check = 98 - as_number(new + plain[:2] + "00") % 97
        signs = iter(plain[:2] + f"{check:02d}" + new)
        return "".join(c if c == " " else next(signs) for c in text)

    return int(digits or "0"), 10 ** len(digits), write


def day(order: str) -> Callable[[str], Ranked]:
    """A calendar date from 1900 to 2099 whose parts come in the given order."""

    def ranked(text: str) -> Ranked:
        parts = dict(zip(order, (int(x) for x in re.findall(r"\d+", text))))
        try:
            rank = (datetime.date(parts["y"], parts["m"], parts["d"]) - FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= rank < DAYS:
            return None

        def write(r: int) -> str:
            date = FIRST_DAY + datetime.timedelta(r)
            whole = {"y": f"{date.year:04d}", "m": f"{date.month:02d}", "d": f"{date.day:02d}"}
            return refill(text, "".join(whole[p] for p in order))

        return rank, DAYS, write

    return ranked


def mail(text: str) -> Ranked:
    """Letters and digits before the @ change among themselves; signs and the domain stay."""
    name, domain = text.rsplit("@", 1)
    sizes = {"a": 26, "A": 26, "0": 10}
    signs = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "" for c in name]
    first = {"a": 97, "A": 65, "0": 48}
    rank, size = 0, 1
    for c, s in zip(name, signs):
        if s:
            rank, size = rank * sizes[s] + ord(c) - first[s], size * sizes[s]

    def write(r: int) -> str:
        out = list(name)
        for k in range(len(out) - 1, -1, -1):
            if s := signs[k]:
                r, value = divmod(r, sizes[s])
                out[k] = chr(first[s] + value)
        return "".join(out) + "@" + domain

    return rank, size, write


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    ranked: Callable[[str], Ranked]
    #: What equal values share and the format: digits for most kinds.
    purpose: Callable[[str], str] = lambda text: re.sub(r"[^0-9]", "", re.sub(r"\d", "0", text))
    #: What must follow the end of the match or of a prefix of it; without it, only the whole match counts.
    border: str = ""


_EDGE, _END = r"(?<![\w.+-])", r"(?![\w-]|\.\d)"
KINDS = (
    Kind("mail", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}", mail, lambda text: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", text.rsplit("@", 1)[0])))),
    Kind("iban", _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", iban, lambda text: text[:2] + re.sub(r"\d", "0", text.replace(" ", "")[4:]), _END),
    Kind("card", _EDGE + r"\d(?:[ -]?\d){12,18}", card, lambda text: text[0] + str(len(only_digits(text))), r"(?!\w|-(?!\d)|\.\d)"),
    Kind("social", _EDGE + r"\d{3}([- ])\d{2}\1\d{4}" + _END, social),
    Kind("phone", r"(?<![\w.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END, phone, phone_format),
    Kind("phone", r"(?<![\w.-])\+[1-9]\d{0,2}(?:[ -]?(?:\(\d{1,4}\)|\d)){5,14}" + _END, phone_abroad, abroad_format),
    Kind("ip", _EDGE + r"\d{1,3}(?:\.\d{1,3}){3}" + _END, ip, lambda text: "v4"),
    Kind("date", _EDGE + r"\d{4}([-/.])\d{2}\1\d{2}(?:(?=T\d{2}:?\d{2})|" + _END + ")", day("ymd"), lambda text: "day"),
    Kind("date", _EDGE + r"\d{2}([-.])\d{2}\1\d{4}" + _END, day("dmy"), lambda text: "day"),
    Kind("date", _EDGE + r"\d{2}/\d{2}/\d{4}" + _END, day("mdy"), lambda text: "day"),
)
_PATTERNS = [re.compile(k.pattern, re.ASCII) for k in KINDS]
_BORDERS = [re.compile(k.border, re.ASCII) if k.border else None for k in KINDS]
#: What a text must hold for a kind to be looked for: an @, a country with check digits, or four digits close together.
_HINTS = {"mail": re.compile("@"), "iban": re.compile(r"[A-Z]{2}\d{2}")}
_NUMBER = re.compile(r"\d(?:[ ()./-]{0,2}\d){3}", re.ASCII)


def pseudonym(kind: Kind, text: str, key: bytes, inverse: bool = False) -> str | None:
    """The pseudonym of a match, or None when it fails the kind's check."""
    found = kind.ranked(text)
    if found is None:
        return None
    rank, size, write = found
    return write(permute(rank, size, key, f"{kind.name} {kind.purpose(text)}", inverse))


def valid(text: str, k: int) -> Iterator[tuple[int, int]]:
    """Where the kind's values stand: of each start the longest that passes the check."""
    at, border = 0, _BORDERS[k]
    while m := _PATTERNS[k].search(text, at):
        start, end = m.span()
        at = start + 1
        ends = (e for e in range(end, start, -1) if text[e - 1] not in " -" and border.match(text, e)) if border else (end,)
        for e in ends:
            if KINDS[k].ranked(text[start:e]) is not None:
                yield start, e
                at = e
                break


def finds(text: str) -> Iterator[tuple[int, int, Kind]]:
    """Valid matches in order, without overlaps."""
    hinted = {hint: bool(hint.search(text)) for hint in (*_HINTS.values(), _NUMBER)}
    found = sorted((start, k, end) for k, kind in enumerate(KINDS) if hinted[_HINTS.get(kind.name, _NUMBER)] for start, end in valid(text, k))
    at = 0
    for start, k, end in found:
        if start >= at:
            yield start, end, KINDS[k]
            at = end


def replaced(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of each find in the given text."""
    out, spans, at = [], [], 0
    for start, end, kind in finds(text):
        out += [text[at:start], pseudonym(kind, text[start:end], key, inverse)]
        spans.append((start, end, kind.name))
        at = end
    return "".join(out) + text[at:], spans


def pseudonymize(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """``doc_id, text, n_found, kinds`` for every row; kinds lists start-end:kind of each find, in characters of the given text."""
    secret = hashlib.blake2b(key, digest_size=32).digest()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(SCHEMA))
        for doc_id, data in rows_of(batches):
            if data is None:
                yield from out.add((doc_id, None, 0, ""))
                continue
            text, spans = replaced(data.decode(), secret, inverse)
            kinds = " ".join(f"{a}-{b}:{kind}" for a, b, kind in spans)
            yield from out.add((doc_id, text, len(spans), kinds), len(data))
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)
