"""Format-preserving pseudonyms by a keyed Feistel permutation.

Numbers that pass their checks (payment cards, account numbers, social security numbers, telephone
numbers, IPv4 addresses), dates (a time may follow) and mailboxes are replaced by others of the same format that pass
the same checks. Each kind's values are numbered from 0 and the numbers permuted, so equal values
stay equal in all documents, different ones stay different, and the key restores them.

A date's pseudonym is read back in the order and padding of the date, so equal days written
day-first with zeros, or year-first, share one; month-first and unpadded ones have their own.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import string
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.frames import map_batches

ROUNDS = 10
#: Days that dates are permuted within; others are left as they are.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

_CANDIDATE = re.compile(
    r"(?<![\w.+@-])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?)"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}([./])\d{1,2}\3\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<card>\d(?:[ -]?\d){12,18})"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})"
    # A time may follow a date.
    r")(?:(?![\w@]|[.-]\d)|(?<=\d{4}[-/]\d{2}[-/]\d{2})(?=[Tt]\d{2}:))"
)
#: Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
_MAILBOX = re.compile(r"(?<![\w.%+-])(?P<mail>[A-Za-z0-9._%+-]{1,64})(?=@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b)")


class Permutation:
    """Keyed permutations of the numbers below a size, one for each size and kind."""

    def __init__(self, key: bytes, backward: bool = False):
        # The hash takes keys of up to 64 bytes; a longer one is hashed first, all of it.
        self.key, self.backward = key if len(key) <= 64 else hashlib.blake2b(key).digest(), backward

    def _noise(self, kind: str, size: int, turn: int, half: int) -> int:
        message = f"{kind}|{size}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest(), "big")

    def __call__(self, kind: str, number: int, size: int, allowed: Callable[[int], bool] = lambda n: True) -> int:
        """The number's image; images out of range or not allowed are permuted on until one is."""
        left = max(2, int(size**0.5) + 1)
        right = -(-size // left)
        while True:
            a, b = divmod(number, right)
            for turn in reversed(range(ROUNDS)) if self.backward else range(ROUNDS):
                sign = -1 if self.backward else 1
                if turn % 2:
                    b = (b + sign * self._noise(kind, size, turn, a)) % right
                else:
                    a = (a + sign * self._noise(kind, size, turn, b)) % left
            number = a * right + b
            if number < size and allowed(number):
                return number


def _fill(pattern: str, signs: str) -> str:
    """``pattern`` with its letters and digits replaced by ``signs`` in turn."""
    rest = iter(signs)
    return "".join(next(rest) if c.isalnum() else c for c in pattern)


def _alphabet(sign: str) -> str:
    return string.digits if sign.isdigit() else string.ascii_uppercase if sign.isupper() else string.ascii_lowercase


def _signs(permute: Permutation, kind: str, signs: str, allowed: Callable[[str], bool] = lambda s: True) -> str:
    """Permutes a string among those with a digit, upper or lower case letter in the same places."""
    alphabets = [_alphabet(c) for c in signs]
    size, number = 1, 0
    for sign, alphabet in zip(signs, alphabets):
        size, number = size * len(alphabet), number * len(alphabet) + alphabet.index(sign)

    def spelled(n: int) -> str:
        out = []
        for alphabet in reversed(alphabets):
            n, at = divmod(n, len(alphabet))
            out.append(alphabet[at])
        return "".join(reversed(out))

    shape = "".join("d" if a == string.digits else "A" if a == string.ascii_uppercase else "a" for a in alphabets)
    return spelled(permute(kind + shape, number, size, lambda n: allowed(spelled(n))))


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _card(permute: Permutation, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = _signs(permute, "card", digits[:-1], lambda p: len(set(p + luhn_digit(p))) > 1)
    return _fill(found, payload + luhn_digit(payload))


def _iban(permute: Permutation, found: str) -> str | None:
    signs = found.replace(" ", "")
    country, check, rest = signs[:2], signs[2:4], signs[4:]
    if iban_digits(country, rest) != check:
        return None
    rest = _signs(permute, "iban" + country, rest)
    return _fill(found, country + iban_digits(country, rest) + rest)


def _ssn(permute: Permutation, found: str) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = found.replace("-", "")
    return _fill(found, _signs(permute, "ssn", digits, valid)) if valid(digits) else None


def _ip(permute: Permutation, found: str) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    number = permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _phone(permute: Permutation, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 8 <= len(digits) <= 15:
        return None
    # The country code is told from the digits, so spaces after it make no difference; it stays.
    country = next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRY_CODES), digits[:3]) if found[0] == "+" else ""
    return _fill(found, country + _signs(permute, "phone" + (country or "1"), digits[len(country) :]))


def _date(permute: Permutation, found: str) -> str | None:
    mark = re.search(r"\D", found)[0]
    parts = found.split(mark)
    numbers = [int(p) for p in parts]
    for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        try:
            day = dt.date(*(numbers[order.index(c)] for c in "ymd")).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        padded = len(parts[0]) == len(parts[1]) == 2 or order == "ymd"

        def told(number: int) -> bool:
            """Read in the same order and with the same padding as the date it stands for."""
            date = dt.date.fromordinal(FIRST_DAY + number)
            plain = padded or date.day < 10 or date.month < 10
            return plain and (order != "mdy" or date.day > 12)

        if not told(day - FIRST_DAY):
            return None
        kind = "date" + (order if order == "mdy" else "") + ("" if padded else "short")
        new = dt.date.fromordinal(FIRST_DAY + permute(kind, day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, told))
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
        return mark.join(value[c] for c in order)
    return None


def _mail(permute: Permutation, found: str) -> str | None:
    signs = "".join(c for c in found if c.isalnum())
    return _fill(found, _signs(permute, "mail", signs)) if signs else None


KINDS: dict[str, Callable[[Permutation, str], str | None]] = {"card": _card, "date": _date, "iban": _iban, "ip": _ip, "mail": _mail, "phone": _phone, "ssn": _ssn}


def replace(text: str, permute: Permutation, known: dict[tuple[str, str], str | None]) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind; ``known`` keeps values met before."""
    counts: dict[str, int] = {}

    def stand_in(m: re.Match) -> str:
        kind, found = m.lastgroup, m[m.lastgroup]
        if (kind, found) not in known:
            if len(known) > 100_000:
                known.clear()
            known[kind, found] = KINDS[kind](permute, found)
        new = known[kind, found]
        if new is None:
            return m[0]
        counts[kind] = counts.get(kind, 0) + 1
        return new

    if any(d in text for d in string.digits):
        text = _CANDIDATE.sub(stand_in, text)
    if "@" in text:
        text = _MAILBOX.sub(stand_in, text)
    return text, counts


def pseudonymise(df: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", restore: bool = False) -> DataFrame:
    """``doc_id, text, n_values, kinds``, a row per input row; ``kinds`` counts replaced values by kind.

    With ``restore`` the same secret undoes the replacement. Values that fail their check stay as
    they are, as do all other characters. A null text stays null with no values. Repeated rows are
    treated alike; other columns are ignored; an empty table gives an empty result.
    """

    def columns_of(batch: pa.RecordBatch) -> list:
        permute, known = Permutation(secret, restore), {}
        done = [(None, {}) if t is None else replace(t, permute, known) for t in batch.column(1).to_pylist()]
        return [batch.column(0), [t for t, _ in done], [sum(c.values()) for _, c in done], [sorted(c.items()) for _, c in done]]

    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(source, "doc_id long, text string, n_values long, kinds map<string, long>", columns_of)
