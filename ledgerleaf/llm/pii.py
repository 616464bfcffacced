"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value that passes the check of its kind is turned into a number below the size of its format, permuted
by a keyed Feistel network (walking on until the number is in range and the value valid again), and
written back in the same format. Equal values get equal pseudonyms in every document, however they are
punctuated; the permutation is a bijection, so different values stay different.

| Kind | Check | Kept |
|---|---|---|
| card | 13-19 digits, Luhn | first digit, separators; the check digit is computed anew |
| iban | country, length, mod 97 | country, separators; the check digits are computed anew |
| ssn | area, group and serial in use | separators |
| phone | +, 8-15 digits; or 10 digits as area, exchange, line | country code, separators; whether area and exchange behind +1 are in use |
| ip | four numbers up to 255 | dots |
| date | a day of the calendar, 1900 to 2099 | order and width of day, month and year |
| email | one @, a domain with a dot | domain, punctuation, kind of each character |
| secret | access key id; or what follows password, token, secret, api key: up to the closing quote, else to white space | kind of each character |

Defined cases: a null text stays null, an empty one empty; numbers that fail their check are left as they
are; repeated rows change alike; all other columns pass through whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from ledgerleaf.llm.common import frugal, remembered

ROUNDS = 8
#: Pseudonyms a worker remembers at most.
REMEMBERED = 200_000
#: Characters permuted as one number, and of the longest value that is remembered.
BLOCK = 256

#: Every value below holds one of these.
_ANY = re.compile("[0-9@:=]|A[KS]IA")
_FOUND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<key>(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[ \t]{0,3}[:=][ \t]{0,3})"
    r"(?:(?P<quote>[\"'])(?=(?:(?!(?P=quote))[^\n])++(?P=quote)(?!\w)))?(?(quote)|[\"']?)(?P<secret>(?(quote)(?:(?!(?P=quote))[^\n])++|\S*[^\W_]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}(?P<sep>[./-])[0-9]{1,2}(?P=sep)[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}(?:(?! (?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?!\w|\.[0-9]))[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![\w])"
    r"|(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
)
_CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
_HEX = (string.digits + "abcdef", string.digits + "ABCDEF")
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind these digits."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


class Permuter:
    """Pseudonyms under one key."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def permute(self, kind: str, value: int, size: int) -> int:
        """A permutation of range(size), one for each kind and size."""
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask, width = (1 << half) - 1, -(-half // 8)
        person = hashlib.blake2b(f"{kind}/{size}".encode(), key=self.key, digest_size=32).digest()
        while True:
            left, right = value >> half, value & mask
            for turn in range(ROUNDS):
                mixed = b""
                while len(mixed) < width:
                    mixed += hashlib.blake2b(right.to_bytes(width, "big") + bytes([turn, len(mixed) // 64]), key=person, digest_size=min(64, width + 8)).digest()
                left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
            value = left << half | right
            if value < size:
                return value

    def characters(self, kind: str, text: str, alphabets: list[str]) -> str:
        """Permute a text whose i-th character is of the i-th alphabet, as one number of mixed base."""
        value = size = 0
        size = 1
        for c, letters in zip(text, alphabets):
            value, size = value * len(letters) + letters.index(c), size * len(letters)
        if size == 1:
            return text
        value = self.permute(f"{kind}:" + "".join(str(len(a)) + "," for a in alphabets), value, size)
        out = []
        for letters in reversed(alphabets):
            value, at = divmod(value, len(letters))
            out.append(letters[at])
        return "".join(reversed(out))

    def blocks(self, kind: str, text: str, alphabets: list[str]) -> str:
        """Permute a text of any length, each block under what stands before it."""
        out, before = [], ""
        for start in range(0, len(text), BLOCK):
            part = text[start:start + BLOCK]
            out.append(self.characters(kind + before, part, alphabets[start:start + BLOCK]))
            before = hashlib.blake2b((before + part).encode(), key=self.key, digest_size=16).hexdigest()
        return "".join(out)

    def digits(self, kind: str, text: str, valid=lambda _: True) -> str:
        """Permute a digit string, on until it is valid."""
        while True:
            text = self.characters(kind, text, [string.digits] * len(text))
            if valid(text):
                return text

    def by_class(self, kind: str, text: str) -> str:
        """Permute letters and digits, each within its kind; hexadecimal text stays that."""
        hexa = next((letters for letters in _HEX if len(text) >= 8 and _is_hex(text, letters)), None)
        found = [hexa or next((letters for letters in _CLASSES if c in letters), "" if c.isascii() else _alike(c)) for c in text]
        at = [i for i, letters in enumerate(found) if letters]
        alphabets = [found[i] for i in at]
        new = list(text)
        while True:
            for i, c in zip(at, self.blocks(kind, "".join(new[i] for i in at), alphabets)):
                new[i] = c
            if not hexa or _is_hex("".join(new), hexa):
                break
        return "".join(new)

    def value(self, kind: str, text: str) -> str:
        if len(text) > BLOCK:
            return getattr(self, f"_{kind}")(text)
        if (found := self.known.get((kind, text))) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[kind, text] = getattr(self, f"_{kind}")(text)
        return found

    def _card(self, text: str) -> str:
        digits = re.sub("[ -]", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return text
        body = digits[0] + self.digits("card" + digits[0], digits[1:-1])
        return _refill(text, body + luhn_digit(body))

    def _iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return text
        rest = self.by_class("iban" + plain[:2], plain[4:])
        new = iter(plain[:2] + _iban_check(plain[:2], rest) + rest)
        return "".join(" " if c == " " else next(new) for c in text)

    def _ssn(self, text: str) -> str:
        def used(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = text.replace("-", "")
        return _refill(text, self.digits("ssn", digits, used)) if used(digits) else text

    def _phone(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        if not 8 <= len(digits) <= 15:
            return text
        code = "" if text[0] != "+" else digits[0] if digits[0] in "17" else digits[:2]
        rest = digits[len(code):]
        if code in ("", "1") and len(rest) == 10:
            if _american(rest):
                return _refill(text, code + self.digits("phone1", rest, _american))
            if not code:
                return text
            return _refill(text, code + self.digits("phone1 other", rest, lambda d: not _american(d)))
        return _refill(text, code + self.digits("phone" + code, rest))

    def _ip(self, text: str) -> str:
        parts = list(map(int, text.split(".")))
        if max(parts) > 255:
            return text
        value = self.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _date(self, text: str) -> str:
        parts = re.split("[./-]", text)
        order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
        day = _day(*(int(parts[i]) for i in order))
        if day is None and order == (2, 1, 0):
            order = (2, 0, 1)
            day = _day(*(int(parts[i]) for i in order))
        if day is None:
            return text
        new = datetime.date.fromordinal(_FIRST + self.permute("date", day.toordinal() - _FIRST, _DAYS))
        for i, number in zip(order, (new.year, new.month, new.day)):
            parts[i] = f"{number:0{max(2, len(parts[i]))}d}"
        rest = iter(re.findall("[./-]", text) + [""])
        return "".join(part + next(rest) for part in parts)

    def _email(self, text: str) -> str:
        name, _, domain = text.rpartition("@")
        linked = self.by_class(f"email@{domain.lower()}", name.lower())
        return "".join(n.upper() if c.isupper() else n for c, n in zip(name, linked)) + "@" + domain

    def _key(self, text: str) -> str:
        return text[:4] + self.characters("key", text[4:], [string.ascii_uppercase + string.digits] * 16)

    def _secret(self, text: str) -> str:
        core = re.search(r"[^\W_](?:.*[^\W_])?", text, re.S)
        return text if core is None else text[:core.start()] + self.by_class("secret", core[0]) + text[core.end():]

    def text(self, text: str) -> tuple[str, int]:
        """The text with its pseudonyms, and how many values changed."""
        if not _ANY.search(text):
            return text, 0
        out, done, changed = [], 0, 0
        for m in _FOUND.finditer(text):
            kind = next(k for k in ("email", "key", "secret", "iban", "date", "ip", "phone", "ssn", "card") if m[k] is not None)
            new = self.value(kind, m[kind])
            if new != m[kind]:
                out += [text[done:m.start(kind)], new]
                done, changed = m.end(kind), changed + 1
        return "".join([*out, text[done:]]), changed


@lru_cache(maxsize=4096)
def _alike(c: str) -> str:
    """Letters or digits of the same category near a character outside ASCII."""
    kind = unicodedata.category(c)
    return "" if kind[0] not in "LN" else "".join(x for x in map(chr, range(ord(c) & ~0xFF, (ord(c) | 0xFF) + 1)) if not x.isascii() and unicodedata.category(x) == kind)


def _is_hex(text: str, letters: str) -> bool:
    """Hexadecimal digits, not all of them decimal."""
    return set(text) <= set(letters) and not text.isdigit()


def _refill(text: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _american(digits: str) -> bool:
    return digits[0] > "1" and digits[3] > "1"


def _day(year: int, month: int, day: int) -> datetime.date | None:
    try:
        found = datetime.date(year, month, day)
    except ValueError:
        return None
    return found if 0 <= found.toordinal() - _FIRST < _DAYS else None


def permuter(key: bytes) -> Permuter:
    return remembered(("permuter", key), lambda: Permuter(key))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The same rows and columns with pseudonyms in the text; with `count_col`, also how many values of
    the text changed (a column of that name is replaced). The key never leaves the job: who holds it can undo the permutation."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != count_col])
    at = docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = permuter(key)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(at):
                text = value.as_py()
                new, n = (None, 0) if text is None else found.text(text)
                texts.append(new)
                counts.append(n)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            names = list(batch.schema.names)
            if count_col:
                columns, names = [*columns, pa.array(counts, pa.int64())], [*names, count_col]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType([*docs.schema.fields, *([StructField(count_col, LongType())] if count_col else [])])
    return docs.mapInArrow(frugal(replace), schema)
