"""Exact removal of repeated passages over a Burrows-Wheeler transform of candidate segments.

A passage of ``LENGTH`` bytes that stands in two documents has the same minimizer (the least hash of its
``SEED``-byte strings) in both, so neighbouring windows with one minimizer form a segment, and segments
are compared only under their minimizer. Three passes over blocks of documents:

1. every block lists the minimizers of its windows; those that stand in two documents are candidates;
2. every block sends its distinct segments with a candidate minimizer. A bucket of minimizers sorts its
   segments' suffixes, and breadth-first backward extension on their Burrows-Wheeler transform finds
   common prefixes by increasing length, up to ``LENGTH``: what is still undivided then is one passage,
   and the smallest document of each passage is known;
3. the smallest documents come back to the block, which marks the covered bytes.

A block sends each distinct string once, however often it stands there, so a passage that a third of
all documents share is one row a block. Strings are compared byte by byte; hashes only propose.

At the edges of a passage that many documents hold, one minimizer has a string of its own in nearly every
document. Minimizers with more than ``hot`` strings (besides the first of each block) are therefore not
compared in one bucket: a block cuts their segments into single windows, which are dealt by the hash of
all their bytes. Equal windows still meet, with one row a block, and nothing else meets with them.

Matches never cross documents. A null text is empty. Rows with equal ids never remove from each other;
a row without id counts as later than all others. Repeated rows give repeated results; an empty table
gives an empty result; other columns are kept, but for those with a result's name (see ``prefix``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, buffers, from_blocks, ragged, table, to_blocks

LENGTH, SEED = 50, 26
BLOCK_BYTES = 2 << 20
#: Strings of one minimizer, beyond the first of each block, above which its windows are dealt one by one.
HOT = 8192
_LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seed_hashes(raw: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A hash of the ``seed`` bytes (17 to 32) from each position."""
    n = len(raw) - seed + 1
    words = _mix(np.ndarray((len(raw) - 7,), np.dtype("<u8"), np.ascontiguousarray(raw).data, 0, (1,)) + np.uint64(0x2545F4914F6CDD1D))
    out = words[:n] * np.uint64(0xBF58476D1CE4E5B9)
    for shift, factor in ((8, 0x94D049BB133111EB), (16, 0xD6E8FEB86659FD93), (seed - 8, 0xA0761D6478BD642F)):
        out += words[shift : shift + n] * np.uint64(factor)
    return _mix(out)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    out = x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size : len(x) - size + 1]) if size < width else out


class Segments:
    """Runs of windows with one minimizer in a block's texts: first window, windows, document, minimizer."""

    def __init__(self, offs: np.ndarray, raw: np.ndarray):
        empty = np.zeros(0, np.int64)
        self.start, self.count, self.doc, self.key = empty, empty, empty, np.zeros(0, np.uint64)
        self.hashes = np.zeros(0, np.uint64)
        n = len(raw) - LENGTH + 1
        if n <= 0:
            return
        self.hashes = seed_hashes(raw)
        least = sliding_least(self.hashes, LENGTH - SEED + 1)
        valid = np.zeros(n + 1, bool)
        first, windows = offs[:-1], np.maximum(0, np.diff(offs) - LENGTH + 1)
        edge = np.zeros(n + 1, np.int8)
        has = windows > 0
        np.add.at(edge, first[has], 1)
        np.add.at(edge, (first + windows)[has], -1)
        valid[:n] = np.cumsum(edge[:n], dtype=np.int8) > 0
        begin = valid[:n].copy()
        begin[1:] &= ~valid[: n - 1] | (least[1:] != least[:-1])
        begin[first[has]] = True
        self.start = np.flatnonzero(begin)
        stop = valid[:n] & ~valid[1 : n + 1]
        bounds = np.sort(np.concatenate((self.start, np.flatnonzero(stop) + 1)))
        self.count = bounds[np.searchsorted(bounds, self.start, side="right")] - self.start
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.key = _mix(least[self.start] + np.uint64(0x632BE59BD9B4E019))

    def marks(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A hash of the strings of ``count`` windows from each start, by their two ends."""
        return _mix(self.hashes[start] * np.uint64(0x9FB21C651E98DF25) + self.hashes[start + count + (LENGTH - 1 - SEED)])


def _bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name of each minimizer; equal names only propose."""
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _read(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block with offsets and bytes of their texts and ids to compare."""
    rows = from_blocks(docs.column("rows"))
    offs, raw = buffers(rows.column(1).combine_chunks())
    return rows, offs, raw, np.asarray(pc.fill_null(rows.column(0).cast(pa.int64()), _LAST)).astype(np.int64)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by value, and where each value begins in it."""
    order = np.argsort(values, kind="stable")
    return order, np.flatnonzero(np.diff(values[order], prepend=-1))


_LISTED = [("block", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("twice", pa.binary()), ("extra", pa.binary())]
_SHARED = [("block", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("hot", pa.binary())]


def list_minimizers(docs: pa.Table, buckets: int) -> pa.Table:
    """Pass 1: distinct minimizers of a block by bucket, which of them two documents share, and how many
    strings beyond the first each has there."""
    _, offs, raw, ids = _read(docs)
    own = Segments(offs, raw)
    bucket, name = _bucket(own.key, buckets)
    full = (bucket << 32) | name
    order = np.lexsort((ids[own.doc], full))
    full, who = full[order], ids[own.doc][order]
    first = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1]))) if len(full) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(full)) - 1
    twice = who[first] != who[last] if len(first) else np.zeros(0, bool)
    distinct, sizes = full[first], np.diff(first, append=len(full))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    marks = own.marks(own.start, own.count)[order[several]]
    by = np.lexsort((marks, full[several]))
    named, marks = full[several][by], marks[by]
    more = np.flatnonzero((named[1:] == named[:-1]) & (marks[1:] != marks[:-1]))
    extra = np.bincount(np.searchsorted(distinct, named[more]), minlength=len(distinct))
    _, edges = _groups(distinct >> 32)
    block = docs.column("block")[0].as_py()
    rows = [
        (block, int(part[0] >> 32), (part & 0xFFFFFFFF).astype("<u4").tobytes(), np.packbits(flags).tobytes(), _pack(strings.astype("<u4")))
        for part, flags, strings in zip(*(np.split(x, edges[1:]) for x in (distinct, twice, extra)), strict=True)
        if len(part)
    ]
    return _table(rows, _LISTED)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), k) for c, (_, k) in zip(columns, fields, strict=True)], pa.schema(fields))


def shared_minimizers(lists: pa.Table, most: int) -> pa.Table:
    """Between the passes: names of a bucket that stand in two documents, for each block that has them, and
    which of them are hot: those with over ``most`` strings beyond the first of each block."""
    names = [np.frombuffer(x.as_buffer(), "<u4") for x in lists.column("names")]
    flags = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(n)) for x, n in zip(lists.column("twice"), names, strict=True)]
    extra = [np.frombuffer(_unpack(x), "<u4") for x in lists.column("extra")]
    every, place = np.unique(np.concatenate(names), return_inverse=True)
    hits = np.bincount(place, minlength=len(every)) > 1
    hits[place[np.concatenate(flags) > 0]] = True
    hot = np.bincount(place, weights=np.concatenate(extra), minlength=len(every)) > most
    rows, at = [], 0
    for block, bucket, own in zip(lists.column("block").to_pylist(), lists.column("bucket").to_pylist(), names, strict=True):
        where = place[at : at + len(own)]
        at += len(own)
        kept = hits[where]
        if kept.any():
            rows.append((block, bucket, own[kept].tobytes(), np.packbits(hot[where[kept]]).tobytes()))
    return _table(rows, _SHARED)


class Chosen:
    """A block's strings to compare: first window, windows, document, bucket and name of each.

    Segments whose minimizer is ``wanted`` go whole to the minimizer's bucket. Those of a ``hot`` one go
    window by window to buckets by the window's bytes, numbered behind the others.
    """

    def __init__(self, own: Segments, wanted: np.ndarray, hot: np.ndarray, buckets: int):
        bucket, name = _bucket(own.key, buckets)
        full = (bucket << 32) | name
        cut = np.isin(full, hot)
        whole, parts = np.flatnonzero(np.isin(full, wanted) & ~cut), np.flatnonzero(cut)
        windows = ragged(own.start[parts], own.count[parts])
        single = np.ones(len(windows), np.int64)
        dealt, called = _bucket(own.marks(windows, single), buckets)
        self.start = np.concatenate((own.start[whole], windows))
        self.count = np.concatenate((own.count[whole], single))
        self.doc = np.concatenate((own.doc[whole], np.repeat(own.doc[parts], own.count[parts])))
        self.bucket = np.concatenate((bucket[whole], dealt + buckets))
        self.name = np.concatenate((name[whole], called))

    def strings(self, raw: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Distinct strings in order of appearance, and the string of each."""
        number: dict[bytes, int] = {}
        whole = raw.tobytes()
        ends = (self.start + self.count + LENGTH - 1).tolist()
        which = [number.setdefault(whole[a:b], len(number)) for a, b in zip(self.start.tolist(), ends, strict=True)]
        return list(number), np.array(which, np.int64)


def _names(buckets: list[int], names: pa.ChunkedArray) -> np.ndarray:
    """Bucket and name of all lists as one number each."""
    parts = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) | (b << 32) for b, x in zip(buckets, names, strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x.as_buffer())


_SENT = [
    ("block", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()),
    ("sizes", pa.binary()), ("strings", pa.binary()), ("least", pa.binary()),
]


def send_segments(docs: pa.Table, given: pa.Table, buckets: int) -> pa.Table:
    """Pass 2: distinct candidate segments of a block by bucket, with the smallest document of each."""
    if not docs.num_rows or not given.num_rows:
        return pa.schema(_SENT).empty_table()
    _, offs, raw, ids = _read(docs)
    wanted = _names(given.column("bucket").to_pylist(), given.column("names"))
    flags = [np.unpackbits(np.frombuffer(h.as_buffer(), np.uint8), count=len(n.as_buffer()) // 4) for h, n in zip(given.column("hot"), given.column("names"), strict=True)]
    hot = wanted[np.concatenate(flags) > 0]
    chosen = Chosen(Segments(offs, raw), wanted, hot, buckets)
    bucket, name = chosen.bucket, chosen.name
    strings, number = chosen.strings(raw)
    first = np.unique(number, return_index=True)[1]
    least = np.full(len(strings), _LAST)
    np.minimum.at(least, number, ids[chosen.doc])
    order, edges = _groups(bucket[first])
    block = docs.column("block")[0].as_py()
    # the hot names come back to the block under a bucket of its own
    rows = [(block, -1 - block, hot.astype("<i8").tobytes(), b"", b"", b"")] if len(hot) else []
    for part in np.split(order, edges[1:]):
        if len(part):
            texts = [strings[i] for i in part.tolist()]
            sizes = np.fromiter(map(len, texts), "<u4", len(texts))
            rows.append(
                (block, int(bucket[first[part[0]]]), name[first[part]].astype("<u4").tobytes(), _pack(sizes), _pack(b"".join(texts)), _pack(least[part]))
            )
    return _table(rows, _SENT)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by their first 56 symbols (of 9 bits), by doubling from packs of seven."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    step = 7
    while True:
        order = np.argsort(key, kind="stable")
        if step >= LENGTH:
            return order
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1]))) + 1
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + later
        step *= 2


def same_prefix(symbols: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it whether it shares ``length`` symbols with the one before.

    Intervals of suffixes that begin with a string are extended backward by every symbol that precedes
    them. A string of length l + 1 that ends at a place without a value gives it the common prefix l,
    and only then is it extended further: every place is set once, by increasing l. After ``length``
    rounds the places without a value share at least ``length`` symbols.
    """
    symbols = np.append(symbols + 1, 0)  # the end sorts before everything and stands once
    n = len(symbols)
    order = suffix_array(symbols)
    before = symbols[order - 1]  # the transform
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int8)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for value in range(length):
        single = high - low == 1
        to_low, to_high = [step[low[single]]], [step[low[single]] + 1]
        wide = np.flatnonzero(~single)
        if len(wide):
            sizes = high[wide] - low[wide]
            place = ragged(low[wide], sizes)
            pair = np.repeat(np.arange(len(wide), dtype=np.int64), sizes) * 512 + before[place]
            by = np.argsort(pair, kind="stable")
            ranked = pair[by]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            begin = step[place[by[first]]]
            to_low.append(begin)
            to_high.append(begin + np.diff(first, append=len(ranked)))
        low, high = np.concatenate(to_low), np.concatenate(to_high)
        fresh = lcp[high] < 0
        low, high = low[fresh], high[fresh]
        lcp[high] = value
        if not len(low):
            break
    same = lcp[1:n] < 0
    same[:1] = False
    return order[1:], same


def window_least(strings: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each string, the smallest document of every window of ``LENGTH`` bytes in it."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    symbols = np.zeros(int(ends[-1]), np.int16)
    symbols[ragged(starts, sizes)] = raw.astype(np.int16) + 1
    order, same = same_prefix(symbols)
    windows = sizes - LENGTH + 1
    spots = ragged(starts, windows)
    who = np.full(len(symbols), _LAST)
    who[spots] = np.repeat(least, windows)
    ranked = who[order]
    begin = np.flatnonzero(~same)
    smallest = np.repeat(np.minimum.reduceat(ranked, begin), np.diff(begin, append=len(ranked)))
    out = np.empty(len(symbols), np.int64)
    out[order] = smallest
    return np.split(out[spots], np.cumsum(windows)[:-1])


_ANSWER = [("block", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("least", pa.binary())]


def resolve_bucket(sent: pa.Table) -> pa.Table:
    """Smallest documents of all windows in a bucket's segments, for each block in the order it sent them."""
    if sent.column("bucket")[0].as_py() < 0:
        return _table([(r["block"], r["bucket"], r["names"], b"") for r in sent.select(["block", "bucket", "names"]).to_pylist()], _ANSWER)
    number: dict[bytes, int] = {}
    least: list[int] = []
    names: list[int] = []
    told: list[tuple[int, int, bytes, list[int]]] = []
    for block, bucket, name, sizes, texts, docs in zip(*(sent.column(c) for c, _ in _SENT), strict=True):
        whole, bounds = _unpack(texts), np.cumsum(np.frombuffer(_unpack(sizes), "<u4")).tolist()
        own, at = [], 0
        keys = np.frombuffer(name.as_buffer(), "<u4").tolist()
        for key, end, doc in zip(keys, bounds, np.frombuffer(_unpack(docs), np.int64).tolist(), strict=True):
            string = whole[at:end]
            at = end
            place = number.setdefault(string, len(number))
            if place == len(least):
                least.append(doc)
                names.append(key)
            elif doc < least[place]:
                least[place] = doc
            own.append(place)
        told.append((block.as_py(), bucket.as_py(), name.as_py(), own))
    strings, smallest = list(number), np.array(least, np.int64)
    _, place, count = np.unique(np.array(names), return_inverse=True, return_counts=True)
    found: list[np.ndarray | None] = [None] * len(strings)
    shared = (count[place] > 1) & (max(map(len, strings)) > LENGTH)  # different strings of one window share none
    several = np.flatnonzero(shared)
    if len(several):
        for i, x in zip(several.tolist(), window_least([strings[i] for i in several.tolist()], smallest[several]), strict=True):
            found[i] = x
    for i in np.flatnonzero(~shared).tolist():
        found[i] = np.full(len(strings[i]) - LENGTH + 1, smallest[i])
    rows = [(block, bucket, name, _pack(np.concatenate([found[i] for i in own]))) for block, bucket, name, own in told]
    return _table(rows, _ANSWER)


def mark_bytes(docs: pa.Table, answers: pa.Table, buckets: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Pass 3: rows of a block, offsets and bytes of their texts, and which bytes go."""
    rows, offs, raw, ids = _read(docs)
    gone = np.zeros(len(raw) + 1, np.int64)
    if answers.num_rows:
        told = answers.column("bucket").to_pylist()
        hot = [np.frombuffer(x.as_buffer(), "<i8") for b, x in zip(told, answers.column("names"), strict=True) if b < 0]
        answers = answers.filter(pc.greater_equal(answers.column("bucket"), 0))
        wanted = _names(answers.column("bucket").to_pylist(), answers.column("names"))
        chosen = Chosen(Segments(offs, raw), wanted, np.concatenate(hot) if hot else np.zeros(0, np.int64), buckets)
        bucket = chosen.bucket
        strings, number = chosen.strings(raw)
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
        first = np.unique(number, return_index=True)[1]
        order, edges = _groups(bucket[first])
        given = {b: x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("least"), strict=True)}
        starts = np.zeros(len(strings), np.int64)
        parts, held = [], 0
        for part in np.split(order, edges[1:]):
            if len(part):
                values = np.frombuffer(_unpack(given[int(bucket[first[part[0]]])]), np.int64)
                starts[part] = held + np.cumsum(windows[part]) - windows[part]
                parts.append(values)
                held += len(values)
        least = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        count = chosen.count
        place = ragged(chosen.start, count)
        out = place[least[ragged(starts[number], count)] < np.repeat(ids[chosen.doc], count)]
        np.add.at(gone, out, 1)
        np.add.at(gone, out + LENGTH, -1)
    return rows, offs, raw, np.cumsum(gone[:-1]) > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, prefix: str = "", hot: int = HOT
) -> DataFrame:
    """All columns of each row, its ``n_bytes``, ``n_removed``, ``n_spans`` and the ``kept`` bytes.

    ``whole_characters``: a character goes only if all its bytes go, so that ``kept`` is text again.
    ``prefix`` stands before the names of the four results; a column that has such a name is replaced.
    ``hot``: how many strings of one minimizer may meet in a bucket; the result does not depend on it.
    """
    results = [prefix + c for c in ("n_bytes", "n_removed", "n_spans", "kept")]
    columns = [id_col, text_col, *(c for c in docs.columns if c not in (id_col, text_col, *results))]
    n = block_count(docs, text_col, BLOCK_BYTES)
    blocks = to_blocks(docs, columns, n, id_col, text_col, level=9)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    kinds = ", ".join(f"`{c}` {k}" for c, k in zip(results, ("long", "long", "long", "binary"), strict=True))

    def first(docs_: pa.Table) -> pa.Table:
        return list_minimizers(docs_, n)

    def between(lists_: pa.Table) -> pa.Table:
        return shared_minimizers(lists_, hot)

    def second(docs_: pa.Table, given: pa.Table) -> pa.Table:
        return send_segments(docs_, given, n)

    def third(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        rows, offs, raw, gone = mark_bytes(docs_, answers, n)
        if whole_characters and len(raw):
            begins = np.flatnonzero((raw & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, begins), np.diff(begins, append=len(raw)))
        kept = np.concatenate(([0], np.cumsum(~gone)))[offs]
        left = raw[~gone].tobytes()
        before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
        new = gone & ~before
        new[offs[:-1][offs[:-1] < len(raw)]] |= gone[offs[:-1][offs[:-1] < len(raw)]]
        spans = np.concatenate(([0], np.cumsum(new)))[offs]
        size = np.diff(offs)
        return pa.table(
            [
                *rows.columns,
                pa.array(size),
                pa.array(size - np.diff(kept)),
                pa.array(np.diff(spans)),
                pa.array([left[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary()),
            ],
            [*rows.column_names, *results],
        )

    lists = blocks.groupBy("block").applyInArrow(first, "block int, bucket int, names binary, twice binary, extra binary")
    shared = lists.groupBy("bucket").applyInArrow(between, "block int, bucket int, names binary, hot binary")
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        second, "block int, bucket int, names binary, sizes binary, strings binary, least binary"
    )
    answers = sent.groupBy("bucket").applyInArrow(resolve_bucket, "block int, bucket int, names binary, least binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(third, f"{fields}, {kinds}")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(slim).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
