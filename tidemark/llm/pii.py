"""PII: format-preserving Feistel pseudonyms.

Validated values are found in the text and replaced by a keyed permutation within their own format: a
card number by a card number of the same length, leading digit and valid check digit, a date by another
date written the same way, a phone number by one with the same punctuation, an address by an address. One
day has one pseudonym however it is written: 2020-01-15, 01/15/2020 and 15.1.2020 stay linked. The
permutation is a balanced or unbalanced Feistel network over mixed radices with a keyed BLAKE2b round
function, walked until the result is valid again, so equal values get equal pseudonyms in all documents,
different values different ones, and whoever holds the key can go back. Text outside the values is kept.

A card is looked for on all group borders of a run of numbers, so one that stands directly beside others is
found. Its pseudonym is the same there as anywhere; where it happens to form another valid card with its
neighbours, going back is ambiguous for that run.

Kinds: e-mail addresses (local part and host labels but for the last), payment cards (issuer range, length
and Luhn), IBANs (mod 97), US social security numbers (valid areas), IPv4 addresses (but not after the word
`version` or a `v`), phone numbers, dates from 1900 to 2099, hexadecimal tokens of 32 or more characters,
and tokens of 16 or more that begin as keys do (sk, pk, ghp, xoxb, xoxp, AKIA), with a digit in them or in
one of the forms that need none.

The key comes from `spark.tidemark.pii.key` or the environment's TIDEMARK_PII_KEY; `key_of` fails where
neither is set, unless a key for demonstrations is asked for.

Null texts stay null. Empty texts stay empty. Repeated rows get equal pseudonyms, an empty table gives no
rows, other columns pass. A column n_replaced is added (a column of that name is replaced).
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import lean

#: Rounds of the network, and the public key of tests and demonstrations: pseudonyms under it hide nothing.
ROUNDS, DEMO_KEY = 10, b"public demonstration key"
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: How cards are usually written, beside one group: the most usual first.
GROUPINGS = {(4, 4, 4, 4): 1, (4, 6, 5): 1, (4, 6, 4): 1, (4, 4, 4, 4, 3): 2, (4, 4, 4, 4, 2): 2, (4, 4, 4, 1): 2, (4, 4, 5): 2, (6, 13): 2, (8, 8): 2}
#: Leading digits and lengths of card numbers by issuer.
ISSUERS = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}"
    r"|(?:6011|64[4-9]\d|65\d\d)(?:\d{12}|\d{15})|62\d\d(?:\d{12}|\d{13}|\d{14}|\d{15})|35(?:2[89]|[3-8]\d)(?:\d{12}|\d{15})|3(?:0[0-5]|095|[689]\d)\d{11}"
    r"|(?:50\d\d|5[6-9]\d\d|6[37]\d\d)\d{8,15}"
)
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: What its form alone makes out; cards are then looked for in what is left, and phones last.
FORMS = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}\b)"
    r"|(?P<secret>(?<![^=:'\"\s])(?=[A-Za-z0-9_]*\d)[0-9a-fA-F]{32,128}\b"
    r"|(?<![A-Za-z0-9_-])(?:sk|pk|ghp|AKIA)[-_]?(?=[A-Za-z0-9_-]*\d)(?:[A-Za-z0-9]+-){0,4}[A-Za-z0-9_]{16,256}(?:-[A-Za-z0-9_]+)*(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_-])(?:[sp]k_(?:live|test)_[A-Za-z]{16,256}|ghp_[A-Za-z]{16,256}|AKIA[A-Z]{16})(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_-])xox[bp][-_]?(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{15,256}[A-Za-z0-9_](?![A-Za-z0-9_]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?<!\bv)(?<!\bversion )(?<!\bVersion )(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
    r"|(?P<date>(?<![\d/.-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?![\d]|[-/.]\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d))"
)
#: Numbers with at most one space or hyphen between: cards stand on the borders of their groups.
RUN = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,}")
NUMBERS = re.compile(
    r"(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[ -]?\d{4}))"
    r"|(?P<phone>(?<![\w+])\+?(?:\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\d]|[.-]\d))"
)
#: A text without any of these holds no value: each alternative of FORMS, RUN and NUMBERS has one within.
HINT = re.compile(r"@|\d[\d ./()-]{5}|[0-9a-fA-F]{32}|[A-Z]{2}\d{2}|\b(?:sk|pk|ghp|xox[bp]|AKIA)[\w-]{16}")


class Feistel:
    """Keyed permutation of the integers below left * right."""

    def __init__(self, key: bytes = DEMO_KEY, rounds: int = ROUNDS):
        self.base, self.rounds = hashlib.blake2b(key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=16), rounds

    def round_value(self, tweak: bytes, i: int, half: int) -> int:
        h = self.base.copy()
        h.update(b"%b|%d|%d" % (tweak, i, half))
        return int.from_bytes(h.digest(), "big")

    def forward(self, value: int, left: int, right: int, tweak: bytes) -> int:
        a, b = divmod(value, right)
        for i in range(self.rounds):
            if i % 2:
                b = (b + self.round_value(tweak, i, a)) % right
            else:
                a = (a + self.round_value(tweak, i, b)) % left
        return a * right + b

    def backward(self, value: int, left: int, right: int, tweak: bytes) -> int:
        a, b = divmod(value, right)
        for i in reversed(range(self.rounds)):
            if i % 2:
                b = (b - self.round_value(tweak, i, a)) % right
            else:
                a = (a - self.round_value(tweak, i, b)) % left
        return a * right + b


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def check_digit(digits: str) -> str:
    return next(c for c in DIGITS if luhn(digits + c))


def is_card(digits: str) -> bool:
    return ISSUERS.fullmatch(digits) is not None and luhn(digits)


def cards(run: str) -> list[tuple[int, int]]:
    """Where in a run of digit groups the valid cards stand, in order.

    Of cards that overlap, one group goes before the usual groupings, those before others, then the first and
    longest. Groups of one or two digits count in the usual groupings and in a card that is the whole run.
    """
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    found = []
    for i, (start, _) in enumerate(groups):
        if run[start] not in "23456":  # no issuer
            continue
        digits, sizes = "", []
        for j in range(i, len(groups)):
            digits += run[groups[j][0] : groups[j][1]]
            sizes.append(groups[j][1] - groups[j][0])
            if len(digits) > 19:
                break
            rank = 0 if j == i else GROUPINGS.get(tuple(sizes), 3) if len({*run[start : groups[j][1]]} & {*" -"}) == 1 else 3
            if len(digits) >= 13 and (rank < 3 or min(sizes) > 2 or j - i + 1 == len(groups)) and is_card(digits):
                found.append((rank, start, -groups[j][1]))
    taken: list[tuple[int, int]] = []
    free = [True] * len(run)
    for _, start, end in sorted(found):
        if all(free[start:-end]):
            free[start:-end] = [False] * (-end - start)
            taken.append((start, -end))
    return sorted(taken)


def iban_valid(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Pseudonymiser:
    """Replaces values under one key; `back` undoes it."""

    def __init__(self, key: bytes = DEMO_KEY):
        self.feistel = Feistel(key)

    def symbols(self, text: str, tweak: str, reverse: bool = False, fixed: int = 0) -> str:
        """Permute the letters and digits of a text, each within its own class; the rest stays."""
        spots = [(i, s) for i, c in enumerate(text) if i >= fixed for s in (DIGITS, LOWER, LOWER.upper()) if c in s]
        if not spots:
            return text
        half = (len(spots) + 1) // 2
        sizes = [1, 1]
        value = 0
        for n, (i, s) in enumerate(spots):
            value = value * len(s) + s.index(text[i])
            sizes[n >= half] *= len(s)
        value = self.step(value, sizes[0], sizes[1], tweak, reverse)
        out = list(text)
        for i, s in reversed(spots):
            value, d = divmod(value, len(s))
            out[i] = s[d]
        return "".join(out)

    def step(self, value: int, left: int, right: int, tweak: str, reverse: bool) -> int:
        if right == 1:
            left, right = 1, left
        return (self.feistel.backward if reverse else self.feistel.forward)(value, left, right, tweak.encode())

    def walked(self, text: str, tweak: str, valid, reverse: bool, fixed: int = 0) -> str:
        """Permute again until the result is valid: a permutation of the valid values."""
        out = self.symbols(text, tweak, reverse, fixed)
        while not valid(out):
            out = self.symbols(out, tweak, reverse, fixed)
        return out

    def value(self, kind: str, text: str, reverse: bool = False) -> str | None:
        """The pseudonym of a value, None where it does not pass its kind's validation."""
        return getattr(self, kind)(text, reverse)

    def email(self, text: str, reverse: bool) -> str:
        local, _, host = text.partition("@")
        name, dot, top = host.rpartition(".")
        return f"{self.walked(local, f'local{len(local)}', lambda x: x[0] != '.', reverse)}@{self.symbols(name, 'host', reverse)}{dot}{top}"

    def secret(self, text: str, reverse: bool) -> str:
        if all(c in HEX for c in text.lower()) and text in (text.lower(), text.upper()):
            low, n = text.lower(), len(text)
            half = n // 2
            out = f"{self.step(int(low, 16), 16 ** (n - half), 16**half, f'hex{n}', reverse):0{n}x}"
            return out if text == low else out.upper()
        lead = re.match(r"(?:[sp]k_(?:live|test)_|(?:sk|pk|ghp|xox[bp]|AKIA)[-_]?)", text)
        return self.symbols(text, "secret", reverse, lead.end() if lead else 0)

    def iban(self, text: str, reverse: bool) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or not iban_valid(plain):
            return None
        body = self.symbols(plain[4:], f"iban{plain[:2]}", reverse)
        number = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00"))
        return spaced(text, f"{plain[:2]}{98 - number % 97:02d}{body}")

    def ip(self, text: str, reverse: bool) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        n = int.from_bytes(bytes(parts), "big")
        host = lambda first: 1 <= first <= 223 and first != 127  # noqa: E731  unicast stays unicast
        while True:
            n = self.step(n, 1 << 16, 1 << 16, "ip", reverse)
            if host(n >> 24) == host(parts[0]):
                return ".".join(map(str, n.to_bytes(4, "big")))

    def date(self, text: str, reverse: bool) -> str | None:
        sep = next(c for c in text if not c.isdigit())
        a, b, c = text.split(sep)
        order = "ymd" if len(a) == 4 else "mdy" if sep == "/" and int(a) <= 12 else "dmy"
        part = dict(zip(order, (a, b, c)))
        try:
            day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        days, place = days_like(day)
        half = math.isqrt(len(days) - 1) + 1
        while True:
            place = self.step(place, half, half, f"date{len(days)}/{days[0]}", reverse)
            if place < len(days):
                break
        d = datetime.date.fromordinal(days[place])
        shown = {"y": f"{d.year:04d}", "m": f"{d.month:0{len(part['m'])}d}", "d": f"{d.day:0{len(part['d'])}d}"}
        return sep.join(shown[x] for x in order)

    def ssn(self, text: str, reverse: bool) -> str | None:
        valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
        return self.walked(text, "ssn", valid, reverse) if valid(text) else None

    def card(self, text: str, reverse: bool) -> str | None:
        plain = re.sub(r"[ -]", "", text)
        if not is_card(plain):
            return self.phone(text, reverse) if len(plain) <= 15 and text[0] != "0" and re.search(r"[ -]", text) else None
        issued = lambda x: ISSUERS.fullmatch(x + "0") is not None  # noqa: E731  the check digit follows from the rest
        body = self.walked(plain[:-1], f"card{len(plain)}", issued, reverse, 1)
        return spaced(text, body + check_digit(body))

    def phone(self, text: str, reverse: bool) -> str | None:
        plain = re.sub(r"\D", "", text)
        if not 7 <= len(plain) <= 15 or plain == text and len(plain) != 10:
            return None
        lead = re.match(r"\+\d{1,3}[ .-]|\+\d", text)
        return self.symbols(text, "phone", reverse, lead.end() if lead else 0)

    def replace(self, text: str | None, reverse: bool = False) -> tuple[str | None, int]:
        if not text or not HINT.search(text):
            return text, 0
        found: list[tuple[int, int, str]] = []  # what is replaced
        forms: list[tuple[int, int]] = []  # what looks like a value, valid or not
        for m in FORMS.finditer(text):
            out = self.value(kind_of(m), m.group(), reverse)
            forms.append(m.span())
            if out is not None:
                found.append((*m.span(), out))
        numbers = []
        for lo, hi in between(found, len(text)):
            for m in RUN.finditer(text, lo, hi):
                for a, b in cards(m.group()):
                    numbers.append((m.start() + a, m.start() + b, self.card(m.group()[a:b], reverse)))
        for lo, hi in between(sorted([*forms, *numbers]), len(text)):
            for m in NUMBERS.finditer(text, lo, hi):
                out = self.value(kind_of(m), m.group(), reverse)
                if out is not None:
                    numbers.append((*m.span(), out))
        parts, at = [], 0
        for start, end, out in sorted(found + numbers):
            parts += (text[at:start], out)
            at = end
        return "".join((*parts, text[at:])), len(found) + len(numbers)


@functools.cache
def day_classes() -> dict[tuple, list[int]]:
    """All days, apart by whether month and day have one digit and whether the day can be taken for a month."""
    found: dict[tuple, list[int]] = {}
    for day in range(FIRST_DAY, LAST_DAY + 1):
        d = datetime.date.fromordinal(day)
        found.setdefault((d.month < 10, d.day < 10, d.day > 12), []).append(day)
    return found


@functools.cache
def day_places() -> dict[int, tuple[list[int], int]]:
    return {day: (days, i) for days in day_classes().values() for i, day in enumerate(days)}


def days_like(day: int) -> tuple[list[int], int]:
    """The days that can stand for `day` in every way of writing it, and its place among them."""
    return day_places()[day]


KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "card", "phone")


def kind_of(m: re.Match) -> str:
    return next(k for k in KINDS if m.groupdict().get(k) is not None)


def between(spans: list[tuple], length: int) -> list[tuple[int, int]]:
    """The stretches that sorted spans leave."""
    out, at = [], 0
    for start, end, *_ in spans:
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return [*out, (at, length)] if at < length else out


def spaced(like: str, plain: str) -> str:
    """The characters of `plain` with the separators of `like`."""
    rest = iter(plain)
    return "".join(next(rest) if c.isalnum() else c for c in like)


def key_of(spark: SparkSession, demo: bool = False) -> bytes:
    """The secret key of the session; raises where none is set and no demonstration is asked for."""
    named = spark.conf.get("spark.tidemark.pii.key", None) or os.environ.get("TIDEMARK_PII_KEY")
    if named:
        return named.encode()
    if demo:
        return DEMO_KEY
    raise ValueError("no key for pseudonyms: set spark.tidemark.pii.key or TIDEMARK_PII_KEY")


def pseudonymise(docs: DataFrame, key: bytes, reverse: bool = False) -> DataFrame:
    """Every row, with the values in its text replaced and their number in n_replaced."""
    columns = [c for c in docs.columns if c != "n_replaced"]
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("n_replaced", T.IntegerType())])

    def run(batches):
        p = Pseudonymiser(key)
        for batch in batches:
            done = [p.replace(t, reverse) for t in batch.column("text").to_pylist()]
            arrays = [pa.array([t for t, _ in done], pa.string()) if n == "text" else batch.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n for _, n in done], pa.int32())], names=[*columns, "n_replaced"])

    return docs.select(*columns).mapInArrow(lean(run), schema)
