"""PII: format-preserving Feistel pseudonyms.

Validated card numbers, phone numbers, social security numbers, IBANs, IPv4 addresses, e-mail names and
dates are replaced by values of the same format: a keyed permutation of all values of that format (a
Feistel network over an integer range, walked until it lands inside).  Equal values get equal pseudonyms
in all documents, however dates and cards are written, and the key takes them back.

At each place of a text the formats are tried in turn; where none validates the search goes on at the next
character, so a number that fails its check digit hides nothing behind it.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

ROUNDS = 8
#: Characters permuted together; longer runs are permuted piece by piece.
PIECE = 64
#: Formats in the order in which they are tried at a place; only ASCII digits make numbers.
FORMATS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])(?<![^\x00-\x7F\s]))(?:[A-Za-z0-9._%+-]|[^\x00-\x7F\s])++(?=@(?:[\w-]++\.)+[^\W\d_]{2,})"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?!\w)"),
    ("phone", r"(?<![\w+])\+[0-9](?:[\x20.-]?[0-9]){7,13}(?!\w)"),
)
KINDS = tuple(dict.fromkeys(k for k, _ in FORMATS))
#: Where a value may begin: a sieve before the formats are tried.
STARTS = r"(?:{})".format("|".join(re.sub(r"\\1", r"[\\x20-]", p) for _, p in FORMATS))
NUMBER_STARTS = r"(?:{})".format("|".join(re.sub(r"\\1", r"[\\x20-]", p) for k, p in FORMATS if k != "email"))
FIRST_YEAR, LAST_YEAR = 1900, 2099


@functools.lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters that may stand for this one: ASCII digits or letters of its case, other letters and digits of its kind within 256 code points."""
    for kind in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in kind:
            return kind
    category = unicodedata.category(c)
    if category[0] not in "LN":
        return ""
    first = max(ord(c) & ~0xFF, 0x80)
    return "".join(x for x in map(chr, range(first, (ord(c) | 0xFF) + 1)) if unicodedata.category(x) == category)


def date_class(day: datetime.date) -> tuple[bool, int]:
    """What a date's spelling shows of it: a month and a day of one or two digits, and whether the day could be a month."""
    return day.month < 10, 0 if day.day < 10 else 1 if day.day <= 12 else 2


@functools.lru_cache(1)
def dates_by_class() -> dict[tuple[bool, int], list[int]]:
    out: dict[tuple[bool, int], list[int]] = {}
    for nth in range(datetime.date(FIRST_YEAR, 1, 1).toordinal(), datetime.date(LAST_YEAR, 12, 31).toordinal() + 1):
        out.setdefault(date_class(datetime.date.fromordinal(nth)), []).append(nth)
    return out


class Feistel:
    """Keyed permutations of 0..n-1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, nth: int, half: int, bits: int) -> int:
        said = self.key + f"{tweak}|{nth}|{half}".encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.shake_256(said).digest((bits + 7) // 8), "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        tweak, mask = f"{tweak}|{n}", (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for nth in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, nth, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, nth, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def characters(self, text: str, tweak: str, back: bool = False) -> str:
        """Permutes digits among digits and letters among letters of their kind; all else stays in place."""
        if len(text) > PIECE:
            return "".join(self.characters(text[i : i + PIECE], f"{tweak}|{i}", back) for i in range(0, len(text), PIECE))
        kinds = [alphabet(c) for c in text]
        size, x = 1, 0
        for c, kind in zip(text, kinds):
            if kind:
                size, x = size * len(kind), x * len(kind) + kind.index(c)
        if size == 1:
            return text
        shape = "".join(k[0] if k else c for c, k in zip(text, kinds))
        x, out = self.permute(x, size, f"{tweak}|{shape}", back), []
        for c, kind in zip(reversed(text), reversed(kinds)):
            if kind:
                x, i = divmod(x, len(kind))
                c = kind[i]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_checks(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


class Pseudonyms:
    """Each method takes a value as written and gives its pseudonym, or None if the value isn't valid."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.formats = [(kind, re.compile(pattern)) for kind, pattern in FORMATS]
        self.starts, self.number_starts = re.compile(STARTS), re.compile(NUMBER_STARTS)
        self.digit = re.compile("[0-9]")

    @staticmethod
    def _refill(shown: str, characters: str) -> str:
        it = iter(characters)
        return "".join(next(it) if c.isalnum() else c for c in shown)

    def email(self, shown: str) -> str | None:
        return self.feistel.characters(shown, "email", self.back)

    def iban(self, shown: str) -> str | None:
        flat = shown.replace(" ", "")
        country, checks, account = flat[:2], flat[2:4], flat[4:]
        if not 15 <= len(flat) <= 34 or iban_checks(country, account) != checks:
            return None
        account = self.feistel.characters(account, "iban" + country, self.back)
        return self._refill(shown, country + iban_checks(country, account) + account)

    def date(self, shown: str) -> str | None:
        """The day is permuted among those that are written alike, whatever the format; it then fits the widths and the order that it was read in."""
        sign = next(c for c in shown if not c.isdigit())
        parts = shown.split(sign)
        for y, m, d in {"-": [(0, 1, 2)], "/": [(2, 0, 1), (2, 1, 0)], ".": [(2, 1, 0)]}[sign]:  # with slashes the month comes first where that is a date
            try:
                day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d]))
            except ValueError:
                continue
            if not FIRST_YEAR <= day.year <= LAST_YEAR:
                return None
            alike = dates_by_class()[date_class(day)]
            nth = self.feistel.permute(bisect.bisect_left(alike, day.toordinal()), len(alike), f"date|{date_class(day)}", self.back)
            new = datetime.date.fromordinal(alike[nth])
            for at, number in ((y, new.year), (m, new.month), (d, new.day)):
                parts[at] = str(number).zfill(len(parts[at]))
            return sign.join(parts)
        return None

    def ssn(self, shown: str) -> str | None:
        area, group, serial = map(int, shown.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.feistel.permute(x, 898 * 99 * 9999, "ssn", self.back), 9999)
        area, group = divmod(x, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, shown: str) -> str | None:
        octets = shown.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip", self.back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def card(self, shown: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", shown)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        payload = self.feistel.characters(digits[:-1], "card", self.back)
        return self._refill(shown, payload + luhn_digit(payload))

    def phone(self, shown: str) -> str | None:
        prefix = re.match(r"\+[0-9]{1,3}(?=[\x20.(-])[\x20.-]?", shown)
        prefix, rest = (shown[: prefix.end()], shown[prefix.end() :]) if prefix else ("", shown)
        digits = re.sub(r"[^0-9]", "", rest)
        return prefix + self._refill(rest, self.feistel.characters(digits, "phone", self.back))

    def _at(self, text: str, at: int) -> tuple[str, int, str] | None:
        for kind, pattern in self.formats:
            if not (match := pattern.match(text, at)):
                continue
            shown, new = match[0], getattr(self, kind)(match[0])
            while new is None and kind == "iban" and " " in shown:  # the last groups may not belong to it
                shown = shown.rpartition(" ")[0]
                new = self.iban(shown)
            if new is not None:
                return kind, at + len(shown), new
        return None

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind."""
        counts: dict[str, int] = {}
        starts = self.starts if "@" in text else self.number_starts if self.digit.search(text) else None
        if starts is None:
            return text, counts
        out, done, at = [], 0, 0
        while match := starts.search(text, at):
            found = self._at(text, match.start())
            if found is None:
                at = match.start() + 1
                continue
            kind, at, new = found
            out += [text[done : match.start()], new]
            done = at
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[done:]]), counts


def pseudonymised(text: Column, key: str, back: bool = False) -> Column:
    """A struct of the text with pseudonyms and n_<kind> counts; null stays null, with counts of 0.

    ``back`` restores the original text, unless a pseudonym and digits beside it happen to make up another
    valid number.  Rows are independent: repeated rows get equal results, an empty table none.  Whole texts
    of any length are searched, in time linear in their length but for runs of digits that fail their
    checks; names of more than ``PIECE`` characters are permuted piece by piece.  Other columns play no part.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pseudonyms = Pseudonyms(secret, back)
        for texts in batches:
            done = [pseudonyms.replace(t) if t else (t, {}) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in done]} | {f"n_{k}": [c.get(k, 0) for _, c in done] for k in KINDS})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "text string, " + ", ".join(f"n_{k} long" for k in KINDS))(text)


def op4_pseudonyms(spark: SparkSession, sf_dir: str, key: str = "pseudonym-key-1") -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", pseudonymised(F.col("text"), key).alias("p"))
    return docs.select("doc_id", "p.*")
