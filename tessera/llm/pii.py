r"""Personal data: spans proposed by regular expressions, confirmed by checksums,
scored with the words around them.

Four base kinds follow fixed patterns and always stay: email, ip, card (Luhn) and
phone.  Further kinds are kept when their score reaches the threshold: a pattern
gives a first score, a checksum (mod-97 for account numbers) or a format rule raises
it, context words near the span raise it, and test or sample words lower it.  Base
spans carry the same score, as information.

All scans run in time linear in the text: dotted numbers are read as whole runs,
addresses are found from their `@`.

Defined results.  A null text counts as empty.  Offsets count code points.  Rows are
judged one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


#: Kinds in order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
THRESHOLD = 0.6
#: Characters on either side that are searched for context words.
NEAR = 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Characters of an account number by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_LENGTH = {country: n for n, countries in _IBAN_LENGTHS.items() for country in countries.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)(?<![A-Za-z])(?:api[_-]?key|secret|token|passwd|password)[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_=-]{16,})")
_CONTEXT = {
    "email": re.compile(r"(?i)mail|contact|write|reach"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address"),
    "card": re.compile(r"(?i)card|visa|master|credit|pay"),
    "phone": re.compile(r"(?i)phone|tel\b|call|mobile|fax"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|cuenta|compte"),
    "ssn": re.compile(r"(?i)ssn|social|security|tax"),
    "secret": re.compile(r"(?i)key|secret|token|passw"),
}
_AGAINST = re.compile(r"(?i)example|sample|dummy|placeholder|test data")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    if "." in text:
        for a, b in _addresses(text):
            yield "ip", a, b
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()


def _account_end(text: str, start: int, length: int) -> int:
    """Where an account number of this length ends, with at most one space after every fourth character; 0 if none does."""
    at = start
    for k in range(length):
        if k and k % 4 == 0 and text[at : at + 1] == " ":
            at += 1
        if not ("A" <= (c := text[at : at + 1]) <= "Z" or "0" <= c <= "9"):
            return 0
        at += 1
    following = text[at : at + 1]
    return 0 if following.isascii() and following.isalnum() else at


def proposed(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Spans of the further kinds with the score of pattern and checksum."""
    for m in _IBAN.finditer(text):
        if (end := _account_end(text, m.start(), _IBAN_LENGTH.get(m.group()[:2], 0))) and mod97(text[m.start() : end].replace(" ", "")):
            yield "iban", m.start(), end, 0.8
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end(), 0.4
    for m in _SECRET.finditer(text):
        kinds = sum(any(f(c) for c in m[1]) for f in (str.isdigit, str.islower, str.isupper))
        yield "secret", m.start(1), m.end(1), 0.4 + 0.1 * kinds


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind."""
    out = []
    found = [*((k, a, b, 0.8) for k, a, b in base_spans(text)), *proposed(text)]
    for kind, a, b, score in found:
        around = text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]
        score += 0.3 * bool(_CONTEXT[kind].search(around)) - 0.3 * bool(_AGAINST.search(around))
        if ORDER[kind] < 4 or score >= threshold:
            out.append(Span(kind, a, b, round(min(1.0, max(0.0, score)), 3)))
    return sorted(out, key=lambda s: (s.start, ORDER[s.kind]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _report(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                spans = find(value.as_py() or "", threshold)
                base = [s for s in spans if ORDER[s.kind] < 4]
                counts = [sum(s.kind == k for s in base) for k in KINDS[:4]]
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), max((s.score for s in spans), default=0.0)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score"])

    return run


def report(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans for every row; no shuffle."""
    return docs.select(id_col, text_col).mapInArrow(_report(threshold), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double")


def redact(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in ``text_col``; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, find(t, threshold)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
