"""Secret scans: three fixed patterns, and entropy windows over candidate strings.

Method: candidate strings are runs of token characters; within each, the
maximal stretches of a character class (hex, alphanumeric with a digit, letters
of both cases, base64) are read through a sliding window whose Shannon entropy
follows from incremental counts.  A stretch with a window at or over its
class's threshold is a finding, unless an allow-list pattern fits the candidate
or base findings cover the whole stretch.  Stretches of letters of one case are
no findings: random ones and long words have the same window entropies.

Defined cases: a null or empty text has no findings (and the digest of the
empty string); repeated rows give repeated results; an empty table gives an
empty result; ties at one start are ordered by kind as listed; other columns
are ignored, whatever their names; null and repeated identifiers are carried
along.  Offsets are code points, end exclusive.  Long texts are scanned whole,
in time in proportion to their length and findings.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import map_arrow
from .common import text_slices
from .textnum import Flat

# The base patterns, their least lengths and the order of kinds.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 12
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"]
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX_LEAST = 16
# Strings of token characters that are no secrets.
ALLOWED = [
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"\d{4}-\d\d-\d\d(T[0-9-]*)?",
    r"[0-9+/_=-]+",
    r"([A-Za-z]+[-_/])*[A-Za-z]+[-_/]?\d{1,4}",
    r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}",
]


@dataclass(frozen=True)
class CharClass:
    name: str
    pattern: str
    window: int
    threshold: float
    needs: tuple[str, ...]  # every window's stretch must hold one of each


LOWERS, UPPERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("hex", r"[0-9a-fA-F]", 20, 2.9, ("0123456789", "abcdefABCDEF")),
    CharClass("alnum", r"[0-9A-Za-z]", 20, 3.4, (DIGITS, LOWERS + UPPERS)),
    CharClass("letters", r"[0-9A-Za-z]", 20, 3.9, (LOWERS, UPPERS)),
    CharClass("base64", r"[0-9A-Za-z+/_=-]", 24, 3.7, (DIGITS, LOWERS, UPPERS)),
)
LEAST = min(c.window for c in CLASSES)
_table = lambda chars: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))
IS_HEX = _table("0123456789abcdef")
IS_TOKEN = _table("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
XLOGX = [0.0] + [float(k * np.log2(k)) for k in range(1, 129)]
_allow = re.compile("|".join(f"(?:{p})" for p in ALLOWED))
_stretch = {c.name: re.compile(f"{c.pattern}{{{c.window},}}") for c in CLASSES}


def peak_entropy(s: str, window: int) -> float:
    """The largest Shannon entropy, in bits, of ``window`` consecutive characters; counts change by one step at a time."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c
    best = 0.0
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += XLOGX[c + 1] - XLOGX[c]
        counts[ch] = c + 1
        if i >= window:
            old = s[i - window]
            c = counts[old]
            total += XLOGX[c - 1] - XLOGX[c]
            counts[old] = c - 1
        if i >= window - 1:
            best = max(best, XLOGX[window] / window - total / window)
    return best


def entropy_spans(candidate: str) -> list[tuple[int, int]]:
    """Stretches of a candidate that look random; none if the allow-list fits it."""
    if _allow.fullmatch(candidate):
        return []
    found: set[tuple[int, int]] = set()
    for c in CLASSES:
        for m in _stretch[c.name].finditer(candidate):
            s = m.group()
            if m.span() not in found and all(set(s) & set(need) for need in c.needs) and peak_entropy(s, c.window) >= c.threshold:
                found.add(m.span())
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):  # only those that no other one holds
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


class Cover:
    """The union of some spans, asked whether it holds a stretch."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start) - 1
        return k >= 0 and end <= self.ends[k]


def covered(start: int, end: int, spans: list[tuple[int, int]]) -> bool:
    """Whether the spans together hold everything from start to end."""
    return Cover(spans).holds(start, end)


def scan(texts: pa.Array) -> list[list[tuple[int, str, int]]]:
    """Findings (start, kind, end) of each text, in order of start and kind."""
    flat = Flat(texts)
    found: list[list[tuple[int, str, int]]] = [[] for _ in range(flat.n)]
    if not len(flat.b):
        return found
    data = flat.b.tobytes()
    point = np.zeros(len(flat.b) + 1, np.int64)
    np.cumsum((flat.b & 0xC0) != 0x80, out=point[1:])

    def put(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        doc = np.searchsorted(flat.off, starts, "right") - 1
        base = point[flat.off[doc]]
        return zip(doc.tolist(), (point[starts] - base).tolist(), (point[ends] - base).tolist(), strict=True)

    def documents(marks: list[bytes], where: bytes) -> list[int]:
        hits = []
        for mark in marks:
            at = where.find(mark)
            while at >= 0:
                hits.append(at)
                at = where.find(mark, at + len(mark))
        return np.unique(np.searchsorted(flat.off, np.array(hits, np.int64), "right") - 1).tolist()

    for d in documents(KEYWORDS, data.translate(LOWER)):
        found[d] += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(texts[d].as_py()) if len(m.group(1)) >= ASSIGN_LEAST]
    for d in documents([b"AKIA"], data):
        found[d] += [(m.start(), "access", m.end()) for m in ACCESS.finditer(texts[d].as_py()) if len(m.group()) >= ACCESS_LEAST]
    starts, ends = flat.runs(IS_HEX[flat.b])
    long = ends - starts >= HEX_LEAST
    for d, a, b in put(starts[long], ends[long]):
        found[d].append((a, "hex", b))
    starts, ends = flat.runs(IS_TOKEN[flat.b])
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    base, own = Cover([]), -1
    for (d, a, _), s, e in zip(put(starts, ends), starts.tolist(), ends.tolist(), strict=True):  # in order of the texts
        if d != own:
            base, own = Cover([(x, y) for x, _, y in found[d]]), d
        found[d] += [(a + p, "entropy", a + q) for p, q in entropy_spans(data[s:e].decode()) if not base.holds(a + p, a + q)]
    for f in found:
        f.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return found


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """The text with each finding, overlapping ones as one, replaced by ``mark``."""
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join(out) + text[end:]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                found = scan(texts)
                count = lambda kind: pa.array([sum(x[1] == kind for x in f) for f in found], pa.int64())  # noqa: E731, B023
                base = [joined([x for x in f if x[1] != "entropy"]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array(map(joined, found), pa.string())],
                    names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def clean(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, the texts without their secrets; ``length_col`` is brought up to date."""
    column = df.columns.index(text_col)
    length = df.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, column):
                part, found = batch.slice(at, len(texts)), scan(texts)
                if any(found):
                    old = part.column(column).to_pylist()
                    new = [redact(t, f) if f else t for t, f in zip(old, found, strict=True)]
                    columns = list(part.columns)
                    columns[column] = pa.array(new, columns[column].type)
                    if length is not None:
                        columns[length] = pa.array([len(n) if f else was for n, f, was in zip(new, found, columns[length].to_pylist(), strict=True)], columns[length].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return map_arrow(df, run, df.schema)
