"""Personal data: expressions propose spans, checksums confirm, context scores.

Four base kinds are proposed and kept by fixed rules: e-mail addresses, IPv4
addresses (every part at most 255), payment cards (13 to 19 digits that pass
Luhn) and international phone numbers (9 to 15 digits). Three more kinds start
from a weaker proposal and need more evidence: IBANs must pass the mod-97
check; national phone numbers and US social security numbers carry a prior
score that words in the preceding text raise or lower, and stay at
:data:`KEEP` or above only. Extra spans never overlap a base span.

Defined cases: a null text counts as empty and has no spans; texts are searched
whole; offsets count code points, end exclusive; repeated rows give repeated
rows; other columns pass through :func:`redact` and are ignored by :func:`find`.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "phone_local", "ssn")
#: Least score of a span of an extra kind.
KEEP = 0.6
#: Characters before a span in which context words are sought.
REACH = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits ends where the run's first start ends, so runs
# are entered at their first digit only and never given back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_DIGIT = re.compile(r"[0-9]")

#: Prior score, and words that raise or lower it.
_CONTEXT = {
    "iban": (0.9, re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I), re.compile(r"$^")),
    "phone_local": (0.4, re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|contact)\b", re.I), re.compile(r"\b(?:order|invoice|version|part|item|isbn)\b", re.I)),
    "ssn": (0.4, re.compile(r"\b(?:ssn|social security)\b", re.I), re.compile(r"\b(?:order|invoice|version|part|item|isbn)\b", re.I)),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    """Leftmost matches, found from each ``@``; only the run before it is looked at."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield "email", start, floor, 1.0
        at = text.find("@", max(at + 1, floor))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)``: base kinds in order, then the extra ones, each by start."""
    if not text:
        return []
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end(), 1.0))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end(), 1.0))
    taken = [(s, e) for _, s, e, _ in out]
    for kind, pattern in (("iban", _IBAN), ("phone_local", _LOCAL_PHONE), ("ssn", _SSN)):
        prior, up, down = _CONTEXT[kind]
        for m in pattern.finditer(text):
            if kind == "iban" and not (15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code)):
                continue
            before = text[max(0, m.start() - REACH) : m.start()]
            score = prior + 0.4 * bool(up.search(before)) - 0.3 * bool(down.search(before))
            if score >= KEEP and not any(s < m.end() and m.start() < e for s, e in taken):
                out.append((kind, m.start(), m.end(), min(score, 1.0)))
                taken.append((m.start(), m.end()))
    return out


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, spans)`` of every row."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [key, "spans"])

    return in_small_batches(docs).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {_SPANS}")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge under the first one's kind."""
    found = sorted(spans_of(text), key=lambda s: (s[1], -s[2]))
    if not found:
        return text
    out, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``length``, where present, counted anew for changed texts."""
    names = docs.columns
    at, size = names.index(text), names.index(length) if length in names else None

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redacted(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            if size is not None:
                kept = batch.column(size).to_pylist()
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(kept, old, new, strict=True)], batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        key,
        *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
