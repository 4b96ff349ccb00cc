"""Packing of tokenised documents into near-equal windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; only the rests compete for space. Rests are
dealt into groups of a bounded number of tokens, and each group is partitioned into as many windows
as its tokens need: differencing merges two partial partitions so that the fullest windows of one meet
the emptiest of the other, and the number of windows rises whenever one exceeds the capacity.

Ids never move: the pieces carry their position and checksum. A null text is an empty document with
its end id alone; an empty table gives no pieces; repeated rows are packed as documents of their own;
rows with a null id are packed like others; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, table
from .tokens import encoder, with_end

CAPACITY = 4096
#: Windows that one group is partitioned into, about.
GROUP_WINDOWS = 64
#: Longest piece of a document's rest. Shorter pieces fill windows better and cut documents more often.
REST = 1024


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Item numbers of each of ``ways`` parts with near-equal sums.

    A partial partition is a vector of part sums, falling; the heap gives the two with the largest
    spread, and one is added to the other in opposite order. A merge keeps only its two sides and the order
    of its sums; the parts are told once, from the last merge down.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    heap, merges = [], []
    for item, size in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[0] = size
        heap.append((-size, item, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, sums = heapq.heappop(heap)
        _, b, other = heap[0]
        sums = sums + other[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), len(sizes) + len(merges), sums))
        merges.append((a, b, order))
    window = {heap[0][1]: np.arange(ways)}  # of each part of a partition, where it ends up
    for number in range(len(sizes) + len(merges) - 1, len(sizes) - 1, -1):
        a, b, order = merges[number - len(sizes)]
        ends = window.pop(number)
        placed = np.empty(ways, np.int64)
        placed[order] = ends
        window[a], window[b] = placed, placed[::-1]
    parts: list[list[int]] = [[] for _ in range(ways)]
    for item in range(len(sizes)):
        parts[int(window[item][0])].append(item)
    return parts


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers of each window; no window holds more than ``capacity``."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [sorted(p) for p in parts if p]
        ways += 1


def cuts(length: int, capacity: int, rest: int) -> list[int]:
    """Lengths of a document's pieces: whole windows, then a rest in near-equal pieces of at most ``rest``."""
    whole, left = divmod(length, capacity)
    n = -(-left // rest)
    return [capacity] * whole + [(left + k) // n for k in range(n)]


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, capacity: int, rest: int
) -> DataFrame:
    """One row per piece: the id, start, length, crc of the ids, tokens of the document, a number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for whole in batches:
            for part in slices(whole, text_col):
                flat, ends = with_end(*own.encode(part.column(text_col)), end_id)
                raw = memoryview(np.ascontiguousarray(flat.astype("<u4"))).cast("B")
                rows: list[tuple[int, int, int, int, int]] = []
                for row in range(part.num_rows):
                    first, total, at = int(ends[row]), int(ends[row + 1] - ends[row]), 0
                    for length in cuts(total, capacity, rest):
                        a = (first + at) * 4
                        rows.append((row, at, length, zlib.crc32(raw[a : a + length * 4]), total))
                        at += length
                columns = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])],
                    [id_col, "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, {_PIECE}")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    rest: int = REST,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """Pieces of all documents with their window (``sequence_id``) and offset in it.

    ``sequence_id`` is unique, not dense: the group's number in the high bits, the window's below.
    """
    pieces = save(cut_documents(docs, tokenizer, end_id, id_col, text_col, capacity, rest), "pieces")
    open_ = F.col("length") < capacity
    tokens = pieces.agg(F.sum(F.when(open_, F.col("length")))).first()[0] or 0
    groups = max(1, round(tokens / (group_windows * capacity)))
    # Equal pieces, of repeated rows, are told apart by their place in the written table.
    key = F.pmod(F.xxhash64(F.col(id_col), "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(id_col, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows.column("length").to_pylist()
        number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for window, items in enumerate(windows(sizes, capacity)):
            at = 0
            for item in items:
                number[item], offset[item] = window, at
                at += sizes[item]
        base = rows.column("sequence_id").to_numpy() * (1 << 20)
        rows = rows.set_column(rows.schema.get_field_index("sequence_id"), "sequence_id", pa.array(base + number))
        return rows.append_column("offset", pa.array(offset))

    grouped = pieces.filter(open_).withColumn("sequence_id", key)
    placed = grouped.groupBy("sequence_id").applyInArrow(
        place, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_PIECE}, sequence_id long, offset long"
    )
    full = pieces.filter(~open_).select(
        "*", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(full)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
