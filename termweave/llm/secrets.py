"""Secret scan: fixed patterns plus sliding-window Shannon entropy per character class.

Every text is scanned whole, in the task that reads it; nothing is shuffled. A null text is empty, an
empty table gives an empty result, repeated rows give repeated results, other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, slices, span_count, span_text, table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_base64")

_KEYWORD = r"(password|passwd|secret|token|api_?key)"
_ASSIGN = re.compile(rf"(?ai:{_KEYWORD[1:-1]})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")

#: Parts of a run that look random but are no secrets: identifiers in the usual notation, placeholders,
#: dates. Windows that overlap such a part are not looked at; the rest of the run is.
ALLOW = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"^[0-9_/+=-]+$",
    r"(?i)example|placeholder|changeme|dummy|sample|x{4,}|lorem",
    r"(?i)0123456789|abcdefgh|qwerty",
)

SPANS = "array<struct<kind:string,start:int,end:int>>"


def _members(characters: str) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[[ord(c) for c in characters]] = True
    return lut


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX = _members(_DIGIT + "abcdef")
_TOKEN = _members(_LOWER + _UPPER + _DIGIT + "+/_=-")
_VALUE = re.compile(rb"[A-Za-z0-9+/_-]+=*")
_HEX_RUN = re.compile(rb"[0-9a-fA-F]+")
_SEGMENT = re.compile(rb"[A-Za-z0-9]+|=+")
#: A segment that a span does not grow over: a word, a name of several words, a number.
_WORD = re.compile(rb"[A-Z]?[a-z]{2,}|[A-Z]{3,}|[0-9]{3,}")
#: Segments that make no secret, however many stand in a row: words, names of several words, numbers.
_PLAIN = re.compile(rb"(?:[A-Z]?[a-z]{2,})+|[A-Za-z]|[A-Z]+|[0-9]+|=+")
_DIGITS, _LOWERS, _UPPERS = _members(_DIGIT), _members(_LOWER), _members(_UPPER)


def _runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that cross no break."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | breaks[:-1]))
    ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
    return starts, ends


def high_entropy(candidate: bytes, window: int, least: float) -> tuple[int, int] | None:
    """First and last position covered by windows of at least ``least`` bits a character.

    The window slides by one; the sum of c * log2(c) over its counts is kept by the two counts that
    change, so a step costs the same for every window and alphabet.
    """
    if len(candidate) < window:
        return None
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts, weighed, first, last = [0] * 256, 0.0, -1, -1
    limit = (math.log2(window) - least) * window + 1e-9
    for at, new in enumerate(candidate):
        if at >= window:
            old = candidate[at - window]
            counts[old] -= 1
            weighed += weigh[counts[old]] - weigh[counts[old] + 1]
        counts[new] += 1
        weighed += weigh[counts[new]] - weigh[counts[new] - 1]
        if at >= window - 1 and weighed <= limit:
            last = at + 1
            first = at + 1 - window if first < 0 else first
    return None if first < 0 else (first, last)


def _mixed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs are more than a word or a number."""
    sums = [np.concatenate(([0], np.cumsum(lut[raw], dtype=np.int32))) for lut in (_DIGITS, _LOWERS, _UPPERS)]
    return _varied(*(x[ends] - x[starts] for x in sums))


def _varied(digits, lowers, uppers):
    return (digits > 0) & (lowers + uppers > 0) | (lowers > 2) & (uppers > 2)


def _is_mixed(run: bytes) -> bool:
    counts = (len(run) - len(run.translate(None, x)) for x in (_DIGIT.encode(), _LOWER.encode(), _UPPER.encode()))
    return bool(_varied(*counts))


def _grown(run: bytes, first: int, last: int) -> tuple[int, int]:
    """The covered part, grown over the segments of the run beside it up to a plain word or number."""
    segments = [m.span() for m in _SEGMENT.finditer(run)]
    for a, b in segments:
        if b >= last:
            if a >= last and _WORD.fullmatch(run, a, b):
                break
            last = b
    for a, b in reversed(segments):
        if a <= first:
            if b <= first and _WORD.fullmatch(run, a, b):
                break
            first = a
    return first, last


def class_spans(piece: bytes, window: int, hex_bits: float, base64_bits: float) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a piece of token characters, with windows per character class.

    The piece is cut behind each ``=`` (names before values; the padding of a value stays with it). A run of
    hexadecimal digits in either case has windows of its own, judged by the limit of 16 characters, and
    is reported whole; what is left has windows of the wide class. Paths and names that consist of plain words
    and numbers alone are allowed.
    """
    spans = []
    for part in _VALUE.finditer(piece):
        at, rest = part.start(), []
        for m in _HEX_RUN.finditer(piece, *part.span()):
            if m.end() - m.start() < window or not _is_mixed(m[0]):
                continue
            if high_entropy(m[0].lower(), window, hex_bits):
                spans.append(("entropy_hex", *m.span()))
                rest.append((at, m.start()))
                at = m.end()
        rest.append((at, part.end()))
        for a, b in rest:
            run = piece[a:b]
            if b - a >= window and _is_mixed(run) and (found := high_entropy(run, window, base64_bits)):
                first, last = _grown(run, *found)
                if all(_PLAIN.fullmatch(x) for x in _SEGMENT.findall(run, first, last)):
                    continue
                spans.append(("entropy_base64", a + first, a + last))
    return spans


def _without(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, allowed: list[re.Pattern], window: int
) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the runs, in pieces of at least ``window``, beside the parts that are allowed."""
    pieces = []
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        run, at = raw[start:end].tobytes().decode(), 0
        for a, b in sorted(m.span() for p in allowed for m in p.finditer(run)):
            if a - at >= window:
                pieces.append((start + at, start + a))
            at = max(at, b)
        if end - start - at >= window:
            pieces.append((start + at, end))
    both = np.array(pieces, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def scan_texts(
    texts: pa.Array, window: int = 20, hex_bits: float = 3.0, base64_bits: float = 3.9, allow: tuple[str, ...] = ALLOW
) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text in code points, by start and then kind."""
    offs, raw = buffers(texts)
    spans: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offs) - 1)]
    text = pc.fill_null(texts, "")
    for kind, doubt, pattern in (
        ("assign", pc.match_substring_regex(text, f"(?i){_KEYWORD}"), _ASSIGN),
        ("access", pc.match_substring(text, "AKIA"), _ACCESS),
    ):
        for row in np.flatnonzero(np.asarray(doubt)):
            for m in pattern.finditer(text[int(row)].as_py()):
                if len(m[1]) >= 6 if kind == "assign" else m.end() - m.start() >= 20:
                    spans[row].append((kind, m.start(), m.end()))
    if not len(raw):
        return spans
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[offs] = True
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))

    def add(kind: str, start: int, end: int) -> None:
        row = int(np.searchsorted(offs, start, side="right")) - 1
        base = chars[offs[row]]
        spans[row].append((kind, int(chars[start] - base), int(chars[end] - base)))

    starts, ends = _runs(_HEX[raw], breaks)
    for k in np.flatnonzero(ends - starts >= 24):
        add("hex", starts[k], ends[k])
    starts, ends = _runs(_TOKEN[raw], breaks)
    long = ends - starts >= window
    starts, ends = starts[long], ends[long]
    mixed = _mixed(raw, starts, ends)
    starts, ends = _without(raw, starts[mixed], ends[mixed], [re.compile(p) for p in allow], window)
    for k in np.flatnonzero(_mixed(raw, starts, ends)):
        for kind, a, b in class_spans(raw[starts[k] : ends[k]].tobytes(), window, hex_bits, base64_bits):
            add(kind, starts[k] + a, starts[k] + b)
    for found in spans:
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end) in code points.

    ``options`` are those of :func:`scan_texts`.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for part in slices(whole, text_col):
                found = scan_texts(part.column(text_col), **options)
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(rows, kind)], [id_col, "spans"])

    narrow = docs.select(id_col, text_col)
    return narrow.mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(span_count(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_text(spans, BASE_KINDS), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
