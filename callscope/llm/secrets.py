"""Secret scans: sliding-window Shannon entropy over candidate strings.

Fixed patterns find the base kinds. Beyond them every run of a character class is a
candidate; a window slides over it, its entropy is kept by incremental counts (one
character leaves, one enters), and a candidate with a window at or above the
class's bound is a secret unless an allow-list pattern explains it. Of overlapping
candidates the widest that qualifies is the secret.

Defined results: a null text is empty and has no span; spans are in code points, end
exclusive, of the whole match; an added span never overlaps a base span (of one that
would, the parts outside are added); repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base kinds, in their order, each with the least length of what its group holds.
ASSIGN = re.compile("(" + "|".join(map(_either, ["password", "passwd", "secret", "token"])) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "entropy")
#: A HEX match that can count, found faster than all.
_LONG_HEX = re.compile("[0-9a-f]{32,}")

WINDOW = 20
_SHARE = [0.0, *(c / WINDOW * math.log2(c) for c in range(1, WINDOW + 1))]


@dataclass(frozen=True)
class CharacterClass:
    """pattern: runs of at least WINDOW characters. bits: the entropy from which a window counts. kinds: character kinds a candidate must mix."""

    name: str
    pattern: re.Pattern
    bits: float
    kinds: int


CLASSES = (
    CharacterClass("hex", re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{%d,}|[0-9A-F]{%d,})(?![A-Za-z0-9])" % (WINDOW, WINDOW)), 3.0, 2),
    CharacterClass("alphanumeric", re.compile(r"[A-Za-z0-9]{%d,}" % WINDOW), 3.7, 3),
    CharacterClass("base64", re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % WINDOW), 3.8, 3),
)
#: What looks random but is no secret.
ALLOW_LIST = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"\d{4}-\d{2}-\d{2}[T_-]?[\d:-]*"),  # date or time stamp
    re.compile(r"(?i).*(?:example|sample|placeholder|dummy|x{6,}).*"),  # stand-ins
    re.compile(r"/?(?:[A-Za-z]+|\d{1,4})(?:[/_-](?:[A-Za-z]+|\d{1,4}))+"),  # paths, slugs, names of words
    re.compile(r"(?:0123456789|1234567890)?(?:abcdefghijklmnopqrstuvwxyz)?(?:ABCDEFGHIJKLMNOPQRSTUVWXYZ)?(?:0123456789)?[+/_-]{0,2}"),  # alphabets
)


def window_entropies(text: str) -> Iterator[float]:
    """Shannon entropy, in bits, of every window of WINDOW characters."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c / WINDOW * log2(c)
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        total += _SHARE[n + 1] - _SHARE[n] if n else 0.0
        counts[c] = n + 1
        if k >= WINDOW:
            gone = text[k - WINDOW]
            n = counts[gone]
            total += _SHARE[n - 1] - _SHARE[n] if n > 1 else 0.0
            counts[gone] = n - 1
        if k >= WINDOW - 1:
            yield math.log2(WINDOW) - total


def _kinds(text: str) -> int:
    return any("0" <= c <= "9" for c in text) + any("a" <= c <= "z" for c in text) + any("A" <= c <= "Z" for c in text) + any(c in "+/_-" for c in text)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans by their starts; none overlaps another. Classes are swept one by one: a candidate within a span found before is known, one that is wider replaces what it overlaps."""
    found: list[tuple[int, int]] = []
    for cls in CLASSES:
        new, at = [], 0
        for m in cls.pattern.finditer(text):
            candidate = m.group()
            if _kinds(candidate) < cls.kinds or any(a.fullmatch(candidate) for a in ALLOW_LIST):
                continue
            while at < len(found) and found[at][1] <= m.start():
                at += 1
            inside = at < len(found) and found[at][0] <= m.start() and m.end() <= found[at][1]
            if not inside and any(h >= cls.bits for h in window_entropies(candidate)):
                new.append(m.span())
        if new:
            kept, at = [], 0
            for s, e in found:
                while at < len(new) and new[at][1] <= s:
                    at += 1
                if at == len(new) or e <= new[at][0]:
                    kept.append((s, e))
            found = sorted(kept + new)
    return found


def _outside(spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What of the spans lies in no base span; both are sorted by their starts and swept together."""
    whole: list[list[int]] = []  # base spans, overlapping ones joined
    for s, e, _ in base:
        if whole and s <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], e)
        else:
            whole.append([s, e])
    k = 0
    for at, end in spans:
        while k < len(whole) and whole[k][1] <= at:
            k += 1
        j = k
        while j < len(whole) and whole[j][0] < end:
            if whole[j][0] > at:
                yield at, whole[j][0]
            at = max(at, whole[j][1])
            j += 1
        if at < end:
            yield at, end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]] if "AKIA" in text else []
    found += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans and all spans of a text, as (start, end, kind)."""
    text = text or ""
    base = base_spans(text)
    added = [(s, e, "entropy") for s, e in _outside(entropy_spans(text), base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    base, spans = scan(text)
                    kinds = [k for _, _, k in base]
                    rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), OUT.types[1:]))], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """text with every span, overlapping ones together, replaced."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, _ in scan(text)[1]:
        if end <= at:
            continue
        out += [text[at:start], mark] if start >= at else []
        at = end
    return "".join([*out, text[at:]])
