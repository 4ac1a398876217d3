"""Pseudonyms of personal numbers and dates that keep their format.

A number or date is replaced only if it is valid: a card number by its check digit, a telephone number
by its form and number of digits, an IP address by its octets, a date by the calendar, an IBAN by its remainder.  Its value is
permuted within the values of its format by a keyed Feistel network with cycle walking, so equal values
get equal pseudonyms in every document, different values different ones, and no table of pairs is kept.
Mail names and secret tokens are permuted as strings over their alphabets in the same way.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For tests and examples; production passes its own secret, or sets it for the session.
DEMO_KEY = b"replace this key"
#: Setting of the session that holds the secret key, in hexadecimal digits.
KEY_SETTING = "spark.sigplane.pii.key"
ROUNDS = 8
KINDS = ("secret", "email", "iban", "card", "phone", "ssn", "ip", "date")

_FIND = re.compile(
    r"(?P<secret>\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9_\-+/]{12,})|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,})\b)"
    r"|(?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b)"
    r"|(?P<date>(?<![\d.,/-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|[.,]\d))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])|(?<![\w.,-])0[1-9]\d{1,3}[ -]\d{3,4}[ -]?\d{3,4}(?![\w-]|[.,]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.,-])\d(?:[ -]?\d){12,18}(?![\w-]|[.,]\d))",
    re.I,
)
#: A text without any of these has nothing to find.
_HINT, _KEYS = re.compile(r"\d\d|@|[:=]"), re.compile(r"akia|gh[pousr]_", re.I)
#: How IBANs of a country without a known length are grouped.
_GROUPED = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?", re.I)
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV NI", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_LENGTH = {c: n for n, cs in _IBAN_LENGTHS.items() for c in cs.split()}


class Feistel:
    """A keyed permutation of 0..size-1."""

    def __init__(self, key: bytes, size: int, tweak: str):
        self.size = size
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.half, self.mask = half, (1 << half) - 1
        self.keys = [hmac.digest(key, f"{tweak}:{size}:{r}".encode(), "sha256") for r in range(ROUNDS)]

    def _round(self, key: bytes, x: int) -> int:
        found = hashlib.blake2b(x.to_bytes((self.half + 7) // 8, "big"), key=key, digest_size=(self.half + 7) // 8 + 8).digest()
        return int.from_bytes(found, "big") & self.mask

    def permute(self, x: int) -> int:
        """Walks the cycle until the value is in range: at most 4 steps on average."""
        while True:
            left, right = x >> self.half, x & self.mask
            for key in self.keys:
                left, right = right, left ^ self._round(key, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def invert(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for key in reversed(self.keys):
                left, right = right ^ self._round(key, left), left
            x = left << self.half | right
            if x < self.size:
                return x


@lru_cache(maxsize=4096)
def _network(key: bytes, size: int, tweak: str) -> Feistel:
    return Feistel(key, size, tweak)


def _other(key: bytes, size: int, tweak: str, value: int) -> int:
    return _network(key, size, tweak).permute(value)


def luhn(digits: str) -> int:
    """0 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(found: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = f"{_other(key, 10**n, 'card', int(digits[:n])):0{n}d}"
    return _fill(found, body + str(-luhn(body + "0") % 10))


def phone(found: str, key: bytes) -> str | None:
    """The country code and the separators stay."""
    m = re.match(r"\+\d{1,3}(?=[ .(-])|\+1(?=\d{10}$)|\+\d\d", found) if found[0] == "+" else None
    head, rest = (m[0], found[m.end() :]) if m else ("", found)
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 12 or len(set(digits)) == 1 or not head and found[0] == "0" and len(digits) < 10:
        return None
    n = len(digits)
    return head + _fill(rest, f"{_other(key, 10**n, 'phone' + (head or '+1'), int(digits)):0{n}d}")


def ssn(found: str, key: bytes) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    valid = 898 * 99 * 9999
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = _other(key, valid, "ssn", x)
    area, group, serial = x // (99 * 9999), x // 9999 % 99 + 1, x % 9999 + 1
    area += 1 + (area >= 665)
    return f"{area:03d}-{group:02d}-{serial:04d}"


def ip(found: str, key: bytes) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, _other(key, 1 << 32, "ip", x).to_bytes(4, "big")))


_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST


def date(found: str, key: bytes) -> str | None:
    """Any valid day from 1900 to 2099 becomes another; a day and its other notations stay linked."""
    if "-" in found:
        y, m, d = map(int, found.split("-"))
    elif "." in found:
        d, m, y = map(int, found.split("."))
    else:
        m, d, y = map(int, found.split("/"))
        if m > 12:
            m, d = d, m
    try:
        at = datetime.date(y, m, d).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    new = datetime.date.fromordinal(_FIRST + _other(key, _DAYS, "date", at))
    if "-" in found:
        return new.isoformat()
    a, b = re.split(r"[./]", found)[:2]
    if "." in found:
        return f"{new.day:0{len(a)}d}.{new.month:0{len(b)}d}.{new.year}"
    one, two = (new.month, new.day) if int(a) <= 12 else (new.day, new.month)
    return f"{one:0{len(a)}d}/{two:0{len(b)}d}/{new.year}"


def _iban_remainder(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def iban(found: str, key: bytes) -> str | None:
    """Digits of the account part change and the check digits follow; letters stay."""
    compact = found.replace(" ", "")
    if not 15 <= len(compact) <= 34 or _iban_remainder(compact) != 1:
        return None
    digits = re.sub(r"\D", "", compact[4:])
    n = len(digits)
    body = _fill(compact[4:], f"{_other(key, 10**n, 'iban' + compact[:2], int(digits)):0{n}d}") if n else compact[4:]
    new = compact[:2] + f"{98 - _iban_remainder(compact[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in found)


_ALPHABETS = (("0123456789", "num"), ("0123456789abcdef", "hex"), ("0123456789ABCDEF", "HEX"), ("abcdefghijklmnopqrstuvwxyz", "low"), ("0123456789abcdefghijklmnopqrstuvwxyz", "36"), ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "62"))


def _alphabet(kept: str) -> tuple[str, str]:
    """The smallest alphabet that has all letters, and its name."""
    return next((a, n) for a, n in _ALPHABETS if set(kept) <= set(a))


def _string(found: str, key: bytes, tweak: str) -> str:
    """Letters and digits permuted among strings of their smallest alphabet and number; all else stays."""
    kept = "".join(c for c in found if c.isascii() and c.isalnum())
    if not kept:
        return found
    letters, name = _alphabet(kept)
    base, x = len(letters), 0
    for c in kept:
        x = x * base + letters.index(c)
    while True:  # a string that a smaller alphabet has is the pseudonym of another of that alphabet
        x = y = _other(key, base ** len(kept), f"{tweak}{name}", x)
        out = []
        for _ in kept:
            y, d = divmod(y, base)
            out.append(letters[d])
        if _alphabet("".join(out))[1] == name:
            break
    it = reversed(out)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in found)


def email(found: str, key: bytes) -> str:
    """The name changes, over small letters and digits; the domain stays.  Names with other letters become their bytes' digits behind a sign that no other name has."""
    name, domain = found.rsplit("@", 1)
    plain = name.lower() if name.isascii() else "=" + name.lower().encode().hex()
    return f"{_string(plain, key, 'mail')}@{domain}"


_MAKE: dict[str, Callable[[str, bytes], str | None]] = {"email": email, "iban": iban, "card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date}


def _ends(kind: str, found: str) -> list[int]:
    """Where a valid value that begins with the match may end, best first: a pattern takes what follows it too."""
    if kind in ("card", "phone"):
        return [g.end() for g in re.finditer(r"\d+\)?", found)][::-1]
    if kind == "iban":
        ends = [g.end() for g in re.finditer(r"[^ ]+", found)][::-1]
        own = _IBAN_LENGTH.get(found[:2].upper())
        of_country = [e for e in ends if e - found.count(" ", 0, e) == own]
        return of_country + [e for e in ends if e not in of_country and _GROUPED.fullmatch(found, 0, e)]
    return [len(found)]


def pseudonymized(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The new text, and (begin, end, kind) of what was replaced, as offsets in the old text."""
    if not (_HINT.search(text) or _KEYS.search(text)):
        return text, []
    parts, spans, at, search = [], [], 0, 0
    while m := _FIND.search(text, search):
        kind = next(k for k in KINDS if m[k])
        begin, end = m.span("value") if kind == "secret" and m["value"] else m.span()
        if kind == "secret":
            new, search = _string(text[begin:end], key, "secret"), m.end()
        else:
            tried = ((begin + e, _MAKE[kind](m[0][:e], key)) for e in _ends(kind, m[0]))
            end, new = next((x for x in tried if x[1] is not None), (end, None))
            # What has no valid beginning may hold something that is valid, after its first run of letters and digits.
            search = end if new is not None else begin + re.match(r"\W*\w+", m[0]).end()
        if new is None:
            continue
        parts += [text[at:begin], new]
        spans.append((begin, end, kind))
        at = end
    return "".join([*parts, text[at:]]) if spans else text, spans


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, else the one for examples."""
    found = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(found) if found else DEMO_KEY


def protect(docs: DataFrame, *, key: bytes | None = None, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """``docs`` with pseudonyms in its text, and a column ``spans_col`` of (begin, end, kind).

    Without a key the session's is taken.  A null text stays null and an empty one empty, both without spans.
    Rows, ids and all other columns stay as they are, in number too; only a column named ``spans_col`` is
    replaced.  An empty table gives no rows.
    """
    key = key if key is not None else session_key(docs.sparkSession)
    docs = docs.drop(spans_col)
    names = docs.columns

    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else pseudonymized(t, key) for t in batch[text_col].to_pylist()]
            spans = [[{"begin": a, "end": b, "kind": k} for a, b, k in s] for _, s in done]
            at = batch.schema.get_field_index(text_col)
            changed = batch.set_column(at, batch.schema.field(at), pa.array([t for t, _ in done], batch.schema.field(at).type))
            yield changed.append_column(spans_col, pa.array(spans, spans_type))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{spans_col}` array<struct<begin: int, end: int, kind: string>>").select(*(f"`{c}`" for c in names), spans_col)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymous text and the spans replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return protect(docs).select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_replaced"), "pii_spans")
