"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move their score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are kept whenever their pattern and check hold: parts up to 255, Luhn's
checksum, numbers of digits. Further kinds need a score of ``THRESHOLD``: an IBAN by its country's length and the remainder
of 1 modulo 97, a social security number or a phone number without prefix by words nearby, a MAC address by its form, a
secret by the name that it is given to and by how evenly its characters are spread. A further span that touches a base span or
a further span of an earlier kind goes.

Every pattern looks at each character a bounded number of times, however long a run of digits or letters is: an address is
looked for from its ``@``, numbers only from the first digit of a run. Only the text itself counts, so nothing is shuffled.

Defined results: null and empty texts have no spans; ties can't arise, as spans of a kind never overlap; repeated rows are
judged one by one; long texts are read whole; extra columns stay as they are (a result column whose name is taken gets
another, see ``free_name``); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.shared import bound_batches, free_name

#: Base kinds, then further ones; spans are listed in this order.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "mac", "ssn", "local_phone", "secret")
#: The score that a span of a further kind needs.
THRESHOLD = 0.6
#: Code points before and after a span in which words are looked for, and what one of them adds to the score.
BEFORE, AFTER, CONTEXT = 48, 24, 0.35
SPANS = "array<struct<kind:string,start:int,end:int,score:double,checksum:boolean,context:string>>"

#: Score of a span whose pattern (and checksum, where there is one) holds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.65, "iban": 0.9, "mac": 0.6, "ssn": 0.3, "local_phone": 0.25, "secret": 0.25}

#: Words, in the languages of the tables, next to which a span is likelier to be what it looks like.
NEARBY = {
    "email": "email e-mail mail contact write kontakt correo courriel",
    "ip": "ip address host server client login adresse servidor serveur",
    "card": "card credit debit visa mastercard amex payment karte kreditkarte carte tarjeta cvv",
    "phone": "phone tel telephone call mobile cell fax telefon anruf handy appelez portable teléfono llame móvil",
    "iban": "iban account bank transfer konto compte cuenta",
    "mac": "mac address device ethernet wlan adresse",
    "ssn": "ssn social security taxpayer",
    "local_phone": "phone tel telephone call mobile cell fax telefon anruf handy appelez portable teléfono llame móvil",
    "secret": "api key apikey token secret password passwd pwd bearer authorization credential passwort kennwort contraseña",
}
_NEARBY = {kind: frozenset(words.split()) for kind, words in NEARBY.items()}

#: Lengths of account numbers by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_AT = re.compile("@")
# A look-behind after the first character, so that the search can run from one possible first character to the next.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
_MAC = re.compile(r"[0-9A-Fa-f](?<![0-9A-Za-z:-][0-9A-Fa-f])[0-9A-Fa-f](?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z:-])")
_SSN = re.compile(r"[0-9](?<![0-9A-Za-z-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_LOCAL_PHONE = re.compile(r"[0-9(](?<![0-9A-Za-z.+-][0-9(])(?:(?<=\()[0-9]{2,5}\)|(?<=[0-9])[0-9]{1,4})(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9A-Za-z])")
_SECRET = re.compile(r"[:=]\x20{0,3}[\"']?([A-Za-z0-9+/_-]{16,}+={0,2})")
_NAME = re.compile(r"(?:^|[^A-Za-z])(?:api[_ -]?key|apikey|access[_ -]?key|auth[_ -]?token|token|secret|password|passwd|pwd|bearer|credential)[A-Za-z0-9_]{0,12}[\"']?\x20{0,3}$", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    checksum: bool
    context: str


_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """The sum of the digits, every second one from the right doubled and its own digits added, is a multiple of ten."""
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(_DOUBLED[d] for d in own[1::2])) % 10 == 0


def mod_97(account: str) -> bool:
    """Four characters moved to the end, letters read as 10 to 35: a remainder of 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(raw: str) -> str:
    return "".join(c for c in raw if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """From each ``@`` back to the first character that an address can begin with, and on over its domain."""
    done = 0
    for at in _AT.finditer(text):
        q = at.start()
        if q < done or not (m := _DOMAIN.match(text, q)):
            continue
        start = q
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < q:
            yield start, m.end(), False
            done = m.end()


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield *m.span(), False


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(own := _digits(m[0])) <= 19 and luhn(own):
            yield *m.span(), True


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield *m.span(), False


def _ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _IBAN.finditer(text):
        size, end, n = IBAN_LENGTHS.get(m[0][:2]), m.start(), 0
        while size and n < size and end < m.end():
            n += text[end] != " "
            end += 1
        if n == size and not (end < len(text) and text[end].isalnum()) and (account := text[m.start() : end].replace(" ", "")).isascii() and account.upper() == account and mod_97(account):
            yield m.start(), end, True


def _macs(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _MAC.finditer(text):
        yield *m.span(), False


def _ssns(text: str) -> Iterator[tuple[int, int, bool]]:
    """No number begins with 000, 666 or 9, or has a group of zeros."""
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield *m.span(), False


def _local_phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m[0])) <= 12:
            yield *m.span(), False


def entropy(raw: str) -> float:
    """Bits a character by the frequencies of the characters."""
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values())


def _secrets(text: str) -> Iterator[tuple[int, int, bool]]:
    """Values with digits and with at least three bits a character, given to a name that says what they are."""
    for m in _SECRET.finditer(text):
        own = m[1]
        if any("0" <= c <= "9" for c in own[:64]) and entropy(own) >= 3 and _NAME.search(text, max(0, m.start() - 40), m.start()):
            yield *m.span(1), False


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int, bool]]]] = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "mac": _macs, "ssn": _ssns, "local_phone": _local_phones, "secret": _secrets,
}


def nearby(text: str, kind: str, start: int, end: int) -> str:
    """The kind's words that stand near the span."""
    there = f"{text[max(0, start - BEFORE) : start]} {text[end : end + AFTER]}".lower()
    return ",".join(sorted(_NEARBY[kind] & {x for w in _WORD.findall(there) for x in (w, *w.split("-"))}))


def spans_of(text: str | None) -> list[Span]:
    """All spans, by kind and start."""
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for kind in KINDS if text else ():
        own = []
        for start, end, checksum in _FINDERS[kind](text):
            words = nearby(text, kind, start, end)
            score = round(min(1.0, SCORES[kind] + (CONTEXT if words else 0.0)), 2)
            if kind in BASE or score >= THRESHOLD and not any(start < b and a < end for a, b in taken):
                own.append(Span(kind, start, end, score, checksum, words))
        out += own
        taken += [(s.start, s.end) for s in own]
    return out


def redacted_of(text: str, spans: list[Span]) -> str:
    """The text with ``<KIND>`` for each span; of overlapping ones, the first and longest speaks for all."""
    parts, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            parts += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*parts, text[done:]])


def find(docs: DataFrame, text_col: str = "text", out: str = "personal_data") -> DataFrame:
    """``docs`` with an array of SPANS in column ``out``."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[s._asdict() for s in spans_of(t if isinstance(t, str) else None)] for t in texts], dtype=object)

    return docs.withColumn(free_name(docs, out), of.asNondeterministic()(F.col(text_col)))  # evaluated once, not again in a filter


def redact(docs: DataFrame, text_col: str = "text", out: str = "redacted") -> DataFrame:
    """``docs`` with the text without its spans in column ``out``; null stays null."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted_of(t, spans_of(t)) if isinstance(t, str) else None for t in texts], dtype=object)

    return docs.withColumn(free_name(docs, out), of.asNondeterministic()(F.col(text_col)))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("personal_data")
    counts = [F.size(of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in BASE]
    highest = F.array_max(F.transform(spans, lambda s: s["score"])).alias("highest_score")
    return find(docs).select("doc_id", *counts, F.sha2(listed(of_kinds(spans, *BASE)), 256).alias("base_sha256"), listed(spans).alias("spans"), highest)
