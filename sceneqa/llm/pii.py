"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern and validated (card numbers by their check digit, addresses by range, dates by calendar in
either order of day and month, account numbers by their remainder and their country's length, telephone numbers by their number of digits). A value that passes is replaced by a keyed permutation of the values of its
format: its digits or letters form a mixed-radix number, a Feistel network with keyed rounds permutes these numbers,
and the result is shifted by one inside that permutation, so no value stands for itself. What makes the format stays:
separators, case, a country code, a card's first digit, the mail host, a key's known beginning; check digits are computed
anew. The same value gives the same pseudonym everywhere, however it is spaced or written (a date in another order, a
number of ten digits with or without the code +1, an account number in small letters), so equal values stay linked across documents, and the key's holder can
reverse it. Web tokens and private key blocks are permuted in pieces of 128 characters.

Every place of a text is tried for every kind. Where a form can end in several places, the longest valid end counts that
cuts no other value; if none is valid, the search goes on behind the form's first character.

Digits that could be anything else stay: numbers that fail their check digit, versions, dates that no calendar has in any
order, telephone numbers without separators, brackets or a plus, and national ones that begin with 0; words of fewer than 20 letters and digits that are no
known kind of key. Dates in words or with two-digit years and mail names in scripts that don't put blanks between words stay too.

Null texts stay null. Empty texts, repeated rows and further columns pass unchanged. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from sceneqa.llm.common import byte_view, text_array

ROUNDS = 10
#: The key of tests and demonstrations; production passes its own.
DEMO_KEY = b"demonstration key"
KINDS = ("email", "date", "ip", "iban", "phone", "ssn", "card", "secret")

#: Beginnings of keys that services hand out (fixed values).
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "AIza", "hf_", "npm_", "pypi-", "SG.")
_PREFIX = "|".join(map(re.escape, KEY_PREFIXES))

#: Digits of account numbers with the country, by country (fixed values).
IBAN_DIGITS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Country codes of two digits; 1 and 7 have one, all others three (fixed values).
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

#: Letters of mail names: Latin, Greek and Cyrillic.
_NAME = r"A-Za-zÀ-ÖØ-öø-ʯͰ-ϿЀ-ӿ0-9._%+-"
#: The forms of each kind. Those of telephone and account numbers have no end of their own, see _ends().
FORMS = {
    "email": rf"(?<![{_NAME}])[{_NAME}]+@(?:[A-Za-zÀ-ÖØ-öø-ʯͰ-ϿЀ-ӿ0-9-]+\.)+[A-Za-z]{{2,}}",
    "secret": rf"(?<![\w-])(?:{_PREFIX})[A-Za-z0-9_-]{{16,200}}(?![\w-])|(?<!\w)[0-9A-Fa-f]{{32,128}}(?!\w)"
    r"|(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}(?![\w-])|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "date": r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|(?<![\w:.])[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d)",
    "iban": r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w.+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}"
    r"|(?<![\w+)])(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-]|\.\d)|(?<![\w+.-])(?:1[ .-])?\d{3}(?P<sep>[.-])\d{3}(?P=sep)\d{4}(?![\w-]|\.\d)",
}
PATTERN = re.compile("|".join(f"(?:{form})" for form in FORMS.values()), re.ASCII)
_FORM = {kind: re.compile(form, re.ASCII) for kind, form in FORMS.items()}
_GOES_ON = re.compile(r"\w|[./-]\d")
_GROUPS = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4})*(?: ?[A-Za-z0-9]{1,3})?")


def permute(value: int, left: int, right: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers below left * right: a Feistel network whose halves have these sizes."""
    a, b = divmod(value, right)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        held = b if i % 2 == 0 else a
        said, size = b"%d|%d|%d|%d" % (i, left, right, held), 16 + max(left, right).bit_length() // 8
        digest = hashlib.blake2b(said, key=key, digest_size=size).digest() if size <= 64 else hashlib.shake_256(key + said).digest(size)
        move = int.from_bytes(digest, "big")
        if i % 2 == 0:
            a = (a - move if back else a + move) % left
        else:
            b = (b - move if back else b + move) % right
    return a * right + b


def moved(value: int, left: int, right: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation without a fixed point: one step on, seen through permute()."""
    size = left * right
    if size < 2:
        return value
    return permute((permute(value, left, right, key) + (-1 if back else 1)) % size, left, right, key, back=True)


_SETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_SET_OF = {c: s for s in _SETS for c in s}
_HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")


@lru_cache(10_000)
def _letters(c: str) -> str:
    """The letters of the same case among the 64 code points around another letter; empty for what is none."""
    if c in _SET_OF or not c.isalpha():
        return _SET_OF.get(c, "")
    first = ord(c) & ~63
    near = map(chr, range(first, first + 64))
    return "".join(x for x in near if ord(x) > 127 and x.isalpha() and (x.islower(), x.isupper()) == (c.islower(), c.isupper()))


def move_text(text: str, key: bytes, sets: dict[str, str] = _SET_OF, back: bool = False) -> str:
    """Each character that belongs to a set moves within it; all of them together are one number."""
    at = [i for i, c in enumerate(text) if c in sets]
    half = len(at) // 2
    size = [1, 1]
    value = 0
    for k, i in enumerate(at):
        s = sets[text[i]]
        value = value * len(s) + s.index(text[i])
        size[k >= half] *= len(s)
    value = moved(value, size[0], size[1], key, back)
    out = list(text)
    for i in reversed(at):
        s = sets[text[i]]
        value, r = divmod(value, len(s))
        out[i] = s[r]
    return "".join(out)


def _keyed(key: bytes, about: str) -> bytes:
    """A key of its own for values that have something else in common."""
    return hashlib.blake2b(about.encode(), key=key, digest_size=32).digest()


def move_pieces(text: str, key: bytes, back: bool = False) -> str:
    """A long text, moved in pieces."""
    return "".join(move_text(text[i : i + 128], _keyed(key, str(i)), back=back) for i in range(0, len(text), 128))


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(form: str, chars: str) -> str:
    """The characters in the places of letters and digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _email(v: str, key: bytes, back: bool) -> str | None:
    name, _, host = v.rpartition("@")
    if not any(c.isalnum() for c in name) or len(v) > 254:
        return None
    return move_text(name, _keyed(key, host.lower()), {c: s for c in name if (s := _letters(c))}, back) + "@" + host


#: The days from 1900 to 2099 and the halves of their network, two more than the days together.
_FIRST, _DAYS, _HALVES = date(1900, 1, 1), 73_049, (11, 6641)


def _day(year: int, month: int, day: int) -> int | None:
    """The number of a day; None outside of the calendar or the range."""
    try:
        n = (date(year, month, day) - _FIRST).days
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def _date(v: str, key: bytes, back: bool) -> str | None:
    """The year stands first or last. Day and month: with slashes either order that the calendar allows, the day first if both
    do; the pseudonym is written in the same order, padded as the value is, and reads in the same way.
    """
    sep = next(c for c in v if not c.isdigit())
    parts = v.split(sep)
    if len(parts) != 3 or sum(len(p) == 4 for p in parts) != 1:
        return None
    year_first = len(parts[0]) == 4
    year, a, b = (int(p) for p in (parts if year_first else (parts[2], parts[1], parts[0])))  # a, b: month, day as usual
    n, swapped = _day(year, a, b), False
    if n is None and not year_first:
        n, swapped = _day(year, b, a), True
    if n is None:
        return None
    rest = [p for p in parts if len(p) != 4]
    padded = all(len(p) == 2 for p in rest)
    late = (_FIRST + timedelta(n)).day > 12
    while True:  # walks until inside the range, and to a date that is as free to be read in another order as this one
        n = moved(n, *_HALVES, key, back)
        if n < _DAYS and ((d := _FIRST + timedelta(n)).day > 12) == late:
            break
    low, high = (d.day, d.month) if swapped else (d.month, d.day)
    texts = [f"{x:02d}" if padded else str(x) for x in (low, high)]
    return sep.join([f"{d.year}", *texts] if year_first else [*reversed(texts), f"{d.year}"])


def _ip(v: str, key: bytes, back: bool) -> str | None:
    if ":" in v:
        try:
            n = int(ipaddress.IPv6Address(v))
        except ValueError:
            return None
        if "::" in v and not any(c.isdigit() for c in v):  # names with a scope look like that
            return None
        return str(ipaddress.IPv6Address(moved(n, 1 << 64, 1 << 64, key, back)))
    parts = [int(p) for p in v.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in v.split(".")):
        return None
    n = moved(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, key, back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _iban(v: str, key: bytes, back: bool) -> str | None:
    raw = v.replace(" ", "").upper()
    rest = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if not 15 <= len(raw) <= 34 or IBAN_DIGITS.get(raw[:2], len(raw)) != len(raw) or rest(raw[4:] + raw[:4]) != 1:
        return None
    if v != v.upper() and (v != v.lower() or raw[:2] not in IBAN_DIGITS):
        return None
    body = move_text(raw[4:], key + raw[:2].encode(), back=back)
    new = _refill(v, f"{raw[:2]}{98 - rest(body + raw[:2] + '00'):02d}{body}")
    return new if v == v.upper() else new.lower()


def _phone_parts(v: str) -> tuple[str, str] | None:
    """The country code (empty without one) and the digits behind it; None if there are too few or too many. (0) is none."""
    digits = re.sub(r"\D", "", v.replace("(0)", ""))
    if v[0] == "+":
        size = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    else:
        size = max(0, len(digits) - 10)
    code, rest = digits[:size], digits[size:]
    ten = code in ("", "1", "7")
    return (code, rest) if len(digits) <= 15 and (len(rest) == 10 if ten else len(rest) >= 6) else None


def _phone(v: str, key: bytes, back: bool) -> str | None:
    """The code stays. Numbers of the code 1 are the same with and without it."""
    parts = _phone_parts(v)
    if parts is None:
        return None
    code, rest = parts
    new = code + move_text(rest, key + (b"" if code == "1" else code.encode()), back=back)
    return _refill(v.replace("(0)", "(\0)"), new).replace("(\0)", "(0)")


def _ssn(v: str, key: bytes, back: bool) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = v.replace("-", "")
    if not valid(digits):
        return None
    digits = move_text(digits, key, back=back)
    while not valid(digits):  # walks to the next valid number; the walk is a permutation of these too
        digits = move_text(digits, key, back=back)
    return _refill(v, digits)


def _card(v: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", v)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + move_text(digits[1:-1], key + digits[0].encode(), back=back)
    return _refill(v, body + str(luhn(body)))


def _secret(v: str, key: bytes, back: bool) -> str | None:
    if v.startswith("-----BEGIN"):
        a, b = v.index("-----", 10) + 5, v.rindex("-----END")
        return v[:a] + move_pieces(v[a:b], _keyed(key, "block"), back) + v[b:] if any(c.isalnum() for c in v[a:b]) else None
    if v.startswith("eyJ"):
        return "eyJ" + move_pieces(v[3:], _keyed(key, "token"), back) if any(c.isdigit() for c in v) else None
    if prefix := next((p for p in KEY_PREFIXES if v.startswith(p)), ""):
        return prefix + move_text(v[len(prefix) :], key + prefix.encode(), back=back) if any(c.isalnum() for c in v[len(prefix) :]) else None
    upper = any(c in "ABCDEF" for c in v)
    if upper and any(c in "abcdef" for c in v) or not any(c.isdigit() for c in v):
        return None
    return move_text(v.lower(), key, _HEX, back).upper() if upper else move_text(v, key, _HEX, back)


_MAKE: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "date": _date, "ip": _ip, "iban": _iban, "phone": _phone, "ssn": _ssn, "card": _card, "secret": _secret}


def _pseudonym(kind: str, value: str, key: bytes, back: bool) -> str | None:
    return _MAKE[kind](value, hashlib.blake2b(kind.encode(), key=key, digest_size=32).digest(), back)


_remembered = lru_cache(100_000)(_pseudonym)


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """What stands for a value, or the value of a pseudonym (back); None if it isn't a valid value of the kind."""
    return (_remembered if len(value) <= 64 else _pseudonym)(kind, value, key, back)


def _ends(kind: str, text: str, m: re.Match) -> Iterator[int]:
    """Where a value of the form found can end, the longest first."""
    start, end = m.span()
    if kind == "iban":
        for e in range(end, start + 14, -1):
            if (text[e : e + 1] == "" or _GOES_ON.match(text, e) is None) and text[e - 1] != " " and _GROUPS.fullmatch(text, start, e):
                yield e
    elif kind == "phone" and text[start] == "+":
        for e in range(end, start + 7, -1):
            v = text[start:e]
            if v[-1] in "0123456789)" and _GOES_ON.match(text, e) is None and v.count("(") == v.count(")") and _phone_parts(v):
                yield e
    else:
        yield end


def _value(text: str, start: int, key: bytes) -> tuple[str, int, str] | None:
    """The kind, the end and the pseudonym of the value that begins at a place."""
    for kind, form in _FORM.items():
        m = form.match(text, start)
        if m is None:
            continue
        ends = list(_ends(kind, text, m))
        if kind == "phone" and len(ends) > 1:
            ends.sort(key=lambda e: _cuts(text, start, e, key))  # stable: the longest of each
        for e in ends:
            new = pseudonym(kind, text[start:e], key)
            if new is not None:
                return kind, e, new
    return None


def _cuts(text: str, start: int, end: int, key: bytes) -> bool:
    """Whether a telephone number up to this end takes from a value that begins behind one of its blanks."""
    for i in range(start, end):
        if text[i] == " " and (other := _value(text, i + 1, key)) and (other[0] != "phone" or other[1] > end):
            return True
    return False


def replace(text: str, key: bytes, counts: dict[str, int] | None = None) -> str:
    """The text with pseudonyms; counts: gets the number of values of each kind."""
    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        found = _value(text, m.start(), key)
        if found is None:
            at = m.start() + 1
            continue
        kind, end, new = found
        out += [text[done : m.start()], new]
        done = at = end
        if counts is not None:
            counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[done:]])


_DIGIT_OR_AT = np.array([48 <= b <= 57 or b in b"@_-:" for b in range(256)], bool)


def suspects(texts: pa.Array) -> np.ndarray:
    """Whether a text has a digit, an at sign or what joins a key's parts, without which it holds no value."""
    raw, at = byte_view(texts)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_DIGIT_OR_AT[raw], out=before[1:])
    return before[at[1:]] > before[at[:-1]]


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, counted: bool = False) -> DataFrame:
    """The documents with pseudonyms in text; counted: and the columns n_<kind>."""
    schema = docs.schema
    if counted:
        for kind in KINDS:
            schema = StructType([*schema.fields, StructField(f"n_{kind}", LongType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(at).to_pylist()
            numbers: dict[str, list[int]] = {k: [0] * len(out) for k in KINDS}
            for i in np.flatnonzero(suspects(text_array(batch))).tolist():
                counts: dict[str, int] = {}
                out[i] = replace(out[i], key, counts)
                for kind, n in counts.items():
                    numbers[kind][i] = n
            cols = [*batch.columns]
            cols[at] = pa.array(out, pa.string())
            if counted:
                cols += [pa.array(numbers[k], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *[f"n_{k}" for k in KINDS if counted]])

    return docs.mapInArrow(run, schema)
