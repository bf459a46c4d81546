"""Personal data: patterns propose spans, checks confirm them, nearby words adjust their score.

Emails, IP addresses, cards (13 to 19 digits that pass Luhn) and phone numbers always stay once confirmed. The other
kinds stay if their score reaches ``min_score``: an IBAN (mod-97, and the length of its country) does so by its
checksum unless words near it speak of something else; a social security number, a phone number without a country code
and an account number do so only by a word of their kind near them. Words count within ``window`` code points of a
span, as whole words. All patterns run in time linear in the text.

Defined cases: a null text is empty and has no spans; repeated rows are treated alike; an empty table gives an empty
table; other columns are ignored by :func:`find_pii` and kept by :func:`redact`. Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "account")
MIN_SCORE, WINDOW = 0.6, 40

_DOMAIN = r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: A run of local characters fails or matches as a whole, so only its first place is tried (_EMAIL), or the place where the match before ended (_EMAIL_HERE).
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++" + _DOMAIN)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _DOMAIN)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+(./-])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z-]|\.[0-9])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z+./-])[0-9]{8,12}(?![0-9A-Za-z-]|\.[0-9])")

# Total lengths of IBANs by country, as the public registry has them.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Words that make a kind likelier, words that speak against it, and the score of a confirmed span without and with a word for it.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "local_phone": ("phone", "call", "tel", "fax", "mobile", "telefon", "téléphone", "teléfono"),
    "account": ("account", "acct", "bank", "routing", "konto", "compte", "cuenta"),
}
AGAINST = {
    "ip": ("version", "release", "build"),
    "card": ("order", "serial", "isbn"),
    "iban": ("serial", "part", "license", "checksum", "order"),
    "ssn": ("part", "serial", "order", "invoice"),
    "local_phone": ("part", "serial", "order", "invoice", "version", "isbn"),
    "account": ("part", "serial", "order", "invoice", "version", "isbn"),
}
SCORE = {
    "email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95), "iban": (0.8, 1.0), "ssn": (0.4, 0.85),
    "local_phone": (0.35, 0.75), "account": (0.3, 0.7),
}
AGAINST_SCORE = 0.3


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")s?\b", re.IGNORECASE)


_FOR = {kind: _any_word(words) for kind, words in CONTEXT.items()}
_NOT = {kind: _any_word(words) for kind, words in AGAINST.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += (x * 2 - 9 * (x > 4)) if k % 2 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """iban: capital letters and digits."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at):
        yield m.span()
        at = m.end()


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end), by kind as in KINDS and then by place."""
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        size = IBAN_LENGTH.get(plain[:2])
        if size and len(plain) >= size and mod97(plain[:size]):
            end, left = m.start(), size
            while left:
                left -= text[end] != " "
                end += 1
            if end == m.end() or text[end] == " ":
                yield "iban", m.start(), end
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def _free(spans: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that touch none of ``found``."""
    taken = sorted((a, b) for _, a, b in found)
    most = list(accumulate((b for _, b in taken), max))
    return [s for s in spans if not (k := bisect_left(taken, (s[2],))) or most[k - 1] <= s[1]]


def spans_of(text: str, min_score: float = MIN_SCORE, window: int = WINDOW) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind and place. A weak proposal that touches a stronger one is part of it."""
    found = list(proposals(text))
    for kind, rule in (("local_phone", _LOCAL_PHONE), ("account", _ACCOUNT)):
        if weak := [(kind, *m.span()) for m in rule.finditer(text)]:
            found += _free(weak, found)
    out = []
    for kind, start, end in found:
        near = text[max(0, start - window) : start] + " \n " + text[end : end + window]
        score = SCORE[kind][bool(_FOR[kind].search(near))]
        if kind in _NOT and _NOT[kind].search(near):
            score = round(score - AGAINST_SCORE, 2)
        if kind in BASE or score >= min_score:
            out.append((kind, start, end, score))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, min_score: float = MIN_SCORE, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, spans (array of kind, start, end, score, by kind and place), a row per row; with ``keep_text`` the text too, its spans replaced by their kind in brackets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [spans_of(x, min_score, window) for x in texts]
            spans = pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in found], _SPANS)
            columns = [batch.column(0), spans]
            if keep_text:
                columns.append(pa.array([_redacted(t, s) for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc", "spans", "text"][: len(columns)])

    kind = docs.schema[doc_col].dataType.simpleString()
    schema = f"doc {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>" + ", text string" * keep_text
    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(scan, schema).withColumnRenamed("doc", doc_col)


def _redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
