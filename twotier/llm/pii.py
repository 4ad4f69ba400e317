"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern and validated (Luhn, mod 97, calendar, octet and number
ranges); what does not validate stays.  A valid value is a point of the finite set of
values of its format, and a keyed Feistel network permutes that set: equal values get
equal pseudonyms in every document, different ones different pseudonyms, a pseudonym
validates again, and the key gives the value back.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable
from math import isqrt, prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import listed, map_rows, read, row_udf, spans_of

QUERY = "op8_pii"
ROUNDS = 8
#: The key of tests and checks; a real run passes its own secret key.
DEMO_KEY = b"twotier demonstration key"


class Feistel:
    """A keyed permutation of range(size) for any size: an unbalanced Feistel network
    over the smallest rectangle that holds it, walked until the value is inside."""

    def __init__(self, key: bytes, name: str, size: int):
        self.size = size
        self.a = isqrt(size - 1) + 1
        self.b = -(-size // self.a)
        self.seed = hashlib.shake_256(b"%d:" % len(key) + key + b"%d:" % size + name.encode()).digest(32)
        self.bytes = (self.a.bit_length() + 7) // 8 + 8

    def _round(self, n: int, value: int) -> int:
        data = self.seed + bytes([n]) + value.to_bytes((value.bit_length() + 7) // 8, "little")
        return int.from_bytes(hashlib.shake_256(data).digest(self.bytes), "little")

    def _once(self, value: int, backwards: bool) -> int:
        left, right = divmod(value, self.b)  # left < a, right < b
        for n in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
            sign = -1 if backwards else 1
            if n % 2:
                right = (right + sign * self._round(n, left)) % self.b
            else:
                left = (left + sign * self._round(n, right)) % self.a
        return left * self.b + right

    def permute(self, value: int, backwards: bool = False, fits: Callable[[int], bool] = lambda v: True) -> int:
        """The value's image in the subset that ``fits``; the value must fit itself."""
        while True:
            value = self._once(value, backwards)
            if value < self.size and fits(value):
                return value


def _pack(digits: list[int], sizes: list[int]) -> int:
    out = 0
    for d, n in zip(digits, sizes):
        out = out * n + d
    return out


def _unpack(value: int, sizes: list[int]) -> list[int]:
    out = []
    for n in reversed(sizes):
        value, d = divmod(value, n)
        out.append(d)
    return out[::-1]


def _luhn(digits: str) -> int:
    """The Luhn sum modulo 10, 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

# Fixed patterns.  Values end at a character that could not go on.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ipv4": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
            r"(?:(?=[Tt][0-9]{2})|(?![\w/-]|\.[0-9]))",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w]|[.-][0-9])"
             r"|(?<![\w.+-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![\w]|[.-][0-9])",
    "card": r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9])",
}
#: What separates the tokens of a value: where the longest match does not validate, it
#: may be a value and further tokens (a check code, an expiry, an amount).
TOKENS = {"iban": " ", "phone": " .-", "card": " -"}
#: All kinds but e-mail addresses, which are found from their ``@``.
_OTHER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k != "email"))
_LOCAL = re.compile("[A-Za-z0-9._%+-]*")
_LOCAL_START = re.compile("[A-Za-z0-9]")
_DOMAIN = re.compile(PATTERNS["email"].split("@", 1)[1])
_HINT = re.compile(r"[0-9@]")
#: Signs of an address that one network permutes; longer addresses have several.
EMAIL_SIGNS = 320


def next_email(text: str, at: int) -> tuple[int, int] | None:
    """Start and end of the leftmost match of the e-mail pattern from ``at`` on.  The
    name before an ``@`` holds none, so that each sign is read a fixed number of times
    where the pattern alone would read a long run again from each of its signs."""
    sign = text.find("@", at)
    while sign >= 0:
        run = _LOCAL.match(text[at:sign][::-1]).end()  # type: ignore[union-attr]
        start = _LOCAL_START.search(text, sign - run, sign)
        domain = _DOMAIN.match(text, sign + 1) if start else None
        if start and domain:
            return start.start(), domain.end()
        at, sign = sign + 1, text.find("@", sign + 1)
    return None


class Finder:
    """The leftmost match of any kind from a place on; ties go to the first kind of
    PATTERNS.  Places must not decrease from call to call."""

    def __init__(self, text: str):
        self.text = text
        self.email: tuple[int, int] | None = (-1, -1)
        self.other: re.Match | None = None
        self.other_from = -1  # the place from which ``other`` was searched

    def find(self, at: int) -> tuple[str, int, int] | None:
        if self.email and self.email[0] < at:
            self.email = next_email(self.text, at)
        if self.other_from < 0 or (self.other and self.other.start() < at):
            self.other, self.other_from = _OTHER.search(self.text, at), at
        if self.email and (self.other is None or self.email[0] <= self.other.start()):
            return "email", *self.email
        return (self.other.lastgroup, self.other.start(), self.other.end()) if self.other else None  # type: ignore


class Pseudonyms:
    """Finds values in a text and replaces them."""

    def __init__(self, key: bytes, backwards: bool = False):
        self.key, self.backwards = key, backwards
        self.networks: dict[tuple[str, int], Feistel] = {}

    def _permute(self, name: str, size: int, value: int, fits: Callable[[int], bool] = lambda v: True) -> int:
        if len(self.networks) > 10_000:
            self.networks.clear()
        if (name, size) not in self.networks:
            self.networks[name, size] = Feistel(self.key, name, size)
        return self.networks[name, size].permute(value, self.backwards, fits)

    def _digits(self, name: str, digits: list[int], sizes: list[int],
                fits: Callable[[int], bool] = lambda v: True) -> list[int]:
        return _unpack(self._permute(f"{name} {sizes}", prod(sizes), _pack(digits, sizes), fits), sizes)

    @staticmethod
    def _fill(shape: str, digits: str) -> str:
        """``shape`` with its digits replaced in turn."""
        new = iter(digits)
        return "".join(next(new) if c.isdigit() else c for c in shape)

    def card(self, text: str) -> str | None:
        """A pseudonym keeps the sum that decides whether the card and an odd number of
        digits after it validate together, so that it is read as far as its value."""
        digits = re.sub("[ -]", "", text)
        if _luhn(digits) or digits[0] == "0":
            return None
        sizes, after = [9] + [10] * (len(digits) - 2), _luhn(digits + "0")

        def whole(own: list[int]) -> str:
            out = "".join(map(str, [own[0] + 1, *own[1:]]))
            return out + str(-_luhn(out + "0") % 10)

        own = [int(digits[0]) - 1, *map(int, digits[1:-1])]
        return self._fill(text, whole(self._digits("card", own, sizes,
                                                   lambda v: _luhn(whole(_unpack(v, sizes)) + "0") == after)))

    def phone(self, text: str) -> str | None:
        """The country code stays; in the North American plan area and exchange keep
        a first digit from 2 to 9.  Ten-digit numbers outside that plan are permuted
        among themselves."""
        digits = re.sub("[^0-9]", "", text)
        code = re.match(r"\+([0-9]+)", text)
        prefix = ""
        if code:
            prefix = "1" if digits[0] == "1" else code[1] if len(code[1]) <= 3 else digits[:2]
            if len(digits) < 8 or len(digits) > 15:
                return None
        own = [int(c) for c in digits[len(prefix):]]
        north = (not code or prefix == "1") and len(own) == 10
        regular = lambda d: d[0] > 1 and d[3] > 1
        if north and regular(own):
            low = [2 if at in (0, 3) else 0 for at in range(10)]
            new = self._digits(f"phone {prefix}", [c - m for c, m in zip(own, low)], [10 - m for m in low])
            return self._fill(text, prefix + "".join(str(d + m) for d, m in zip(new, low)))
        fits = (lambda v: not regular(_unpack(v, sizes))) if north else lambda v: True
        sizes = [10] * len(own)
        return self._fill(text, prefix + "".join(map(str, self._digits(f"phone {prefix}", own, sizes, fits))))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        new = self._digits("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999])
        area = new[0] + 1
        return f"{area + (area >= 666):03d}-{new[1] + 1:02d}-{new[2] + 1:04d}"

    def ipv4(self, text: str) -> str | None:
        """Every octet keeps its number of digits."""
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        low, sizes = zip(*[((0, 10), (10, 90), (100, 156))[len(o) - 1] for o in octets])
        new = self._digits("ipv4", [int(o) - m for o, m in zip(octets, low)], list(sizes))
        return ".".join(str(d + m) for d, m in zip(new, low))

    def iban(self, text: str) -> str | None:
        """Country and check digits stay, and with them the remainder that decides whether
        the number and the tokens after it validate together."""
        whole = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if number(whole[4:] + whole[:4]) % 97 != 1:
            return None
        country, own = whole[:2], whole[4:]
        rest = number(own) % 97
        if own.isdigit():  # every 97th number has this remainder
            size = -(-(10 ** len(own) - rest) // 97)
            new = self._permute(f"iban {country} {len(own)} {rest}", size, (int(own) - rest) // 97)
            out = f"{new * 97 + rest:0{len(own)}d}"
        else:
            sizes = [10 if c.isdigit() else 26 for c in own]

            def written(digits: list[int]) -> str:
                return "".join(str(d) if n == 10 else chr(65 + d) for d, n in zip(digits, sizes))

            out = written(self._digits(f"iban {country}", [int(c) if c.isdigit() else ord(c) - 65 for c in own], sizes,
                                       lambda v: number(written(_unpack(v, sizes))) % 97 == rest))
        signs = iter(whole[:4] + out)
        return "".join(c if c == " " else next(signs) for c in text)

    def date(self, text: str) -> str | None:
        """A day from 1900 to 2099 in the same notation and length.  Day before month
        where that is a date, else month before day; a pseudonym reads the same way."""
        def read_as(t: str) -> tuple[str, datetime.date] | None:
            if "-" in t:
                order, (y, m, d) = "ymd", map(int, t.split("-"))
            else:
                d, m, y = map(int, re.split("[./]", t))
                order = "dmy"
                if m > 12:
                    order, d, m = "mdy", m, d
            if not 1900 <= y <= 2099 or not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(y, m)[1]:
                return None
            return order, datetime.date(y, m, d)

        def write_as(order: str, day: datetime.date) -> str:
            if order == "ymd":
                return day.isoformat()
            first, second = (day.day, day.month) if order == "dmy" else (day.month, day.day)
            return f"{first:0{widths[0]}d}{text[widths[0]]}{second:0{widths[1]}d}{text[widths[0]]}{day.year}"

        own = read_as(text)
        if own is None:
            return None
        order, day = own
        widths = [len(p) for p in re.split("[./-]", text)[:2]]
        at = lambda v: _FIRST_DAY + datetime.timedelta(v)

        def fits(v: int) -> bool:
            out = write_as(order, at(v))
            return len(out) == len(text) and read_as(out) == (order, at(v))

        if not fits((day - _FIRST_DAY).days):
            return None
        return write_as(order, at(self._permute(f"date {order} {widths}", _DAYS, (day - _FIRST_DAY).days, fits)))

    def email(self, text: str) -> str | None:
        """Letters and digits of all but the top-level domain; the rest keeps its place."""
        own, top = text.rsplit(".", 1)
        kinds = [("0", 10) if c.isdigit() else ("A", 26) if c.isupper() else ("a", 26) if c.islower() else None
                 for c in own]
        values = [ord(c) - ord(k[0]) for c, k in zip(own, kinds) if k]
        sizes, new = [k[1] for k in kinds if k], []
        for n in range(0, len(values), EMAIL_SIGNS):
            new += self._digits(f"email {n}" if n else "email", values[n:n + EMAIL_SIGNS], sizes[n:n + EMAIL_SIGNS])
        new = iter(new)
        return "".join(chr(next(new) + ord(k[0])) if k else c for c, k in zip(own, kinds)) + "." + top

    def _longest(self, kind: str, text: str, start: int, end: int) -> tuple[str | None, int]:
        """The pseudonym of the longest valid value from ``start`` that ends at ``end`` or
        at a token before it, and its end; None without one."""
        new = getattr(self, kind)(text[start:end])
        for cut in range(end - 1, start, -1) if new is None and kind in TOKENS else ():
            if text[cut] in TOKENS[kind] and _ONE[kind].fullmatch(text, start, cut):
                new = getattr(self, kind)(text[start:cut])
                if new is not None:
                    return new, cut
        return new, end

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the new text."""
        if not text or not _HINT.search(text):
            return text, []
        finder = Finder(text)
        out, spans, at, size, found = [], [], 0, 0, finder.find(0)
        while found:
            kind, start, end = found
            new, end = self._longest(kind, text, start, end)
            if new is None:  # another kind may begin at the same place
                for kind in list(PATTERNS)[list(PATTERNS).index(kind) + 1:]:
                    other = _ONE[kind].match(text, start)
                    if other:
                        new, end = self._longest(kind, text, start, other.end())
                        if new is not None:
                            break
            if new is None:
                found = finder.find(start + 1)
                continue
            out += [text[at:start], new]
            size += start - at
            spans.append((kind, size, size + len(new)))
            size += len(new)
            at, found = end, finder.find(end)
        return ("".join(out) + text[at:] if out else text), spans


_ONE = {k: re.compile(p) for k, p in PATTERNS.items()}


def pseudonymized(docs: DataFrame, key: bytes = DEMO_KEY, backwards: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms and spans (array of kind, start, end in code points
    of the new text) of every row of ``docs``; with ``backwards`` pseudonyms turn into
    the values again.

    Every whole text is read.  A null text stays null and an empty one empty, without
    spans.  Overlapping values go to the leftmost, then to the first kind of PATTERNS, then to
    the longest that validates.  Repeated
    rows and null ids are rows like others; an empty table gives an empty result.
    """
    def make():
        pseudonyms = Pseudonyms(key, backwards)

        def work(ids, texts):
            done = [pseudonyms.replace(t) for t in texts]
            return [ids, [t for t, _ in done], [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]]
        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], make,
                    "doc_id bigint, text string, spans array<struct<kind string, start bigint, end bigint>>")


def pseudonymize_column(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with pseudonyms in its text; all other columns unchanged."""
    def make():
        pseudonyms = Pseudonyms(key)
        return lambda text: pseudonyms.replace(text)[0]

    new = row_udf(docs.sparkSession, make, "string")("text")
    return docs.withColumn("text", new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymized(read(spark, sf_dir, "documents"))
    counts = [F.size(spans_of([k])).alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", "text", *counts, listed(F.col("spans")).alias("spans"))
