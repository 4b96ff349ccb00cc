"""Shared helpers of the training-data operators: shared tables, Arrow text buffers, block counts."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import scratch_path

#: Most text that one numpy step handles at once inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: later steps restart from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text each; one cheap pass over the text column."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(16))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and UTF-8 bytes of a string array; nulls count as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


#: What a worker keeps between tasks of one operator; called when another one needs the room.
KEPT: list[Callable[[], None]] = []


#: Of the C library; None where it is not glibc.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return free memory of Arrow and of the C heap: a worker lives on, and other operators need the room."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def make_room() -> None:
    """Drop what other operators' tasks have left in this worker."""
    for drop in KEPT:
        drop()
    give_back()


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about ``most`` bytes of text; a longer text is alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])
    give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length - 1`` of every row, one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def digest(columns: str) -> str:
    return hashlib.sha256(columns.encode()).hexdigest()


def span_text(spans, kinds: tuple[str, ...] | None = None):
    """Column: ``kind:start:end`` of the spans (of the given kinds), comma-joined in their order."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(
        F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_count(spans, kind: str):
    """Column: number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def block_of(id_col, blocks: int, other=None):
    """Column: the block of an id; rows without id are spread by ``other``."""
    key = F.coalesce(id_col.cast("long"), F.xxhash64(other)) if other is not None else id_col.cast("long")
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def to_blocks(docs: DataFrame, columns: list[str], blocks: int, id_col: str, text_col: str, level: int = 6) -> DataFrame:
    """The rows dealt into blocks and packed for the shuffle: (block, rows).

    ``rows`` holds the rows of one block that one task has met, as a compressed Arrow stream; it takes
    about two thirds of the bytes that the rows themselves would take in a shuffle.
    """
    narrow = docs.select(block_of(F.col(id_col), blocks, F.col(text_col)).alias("__block"), *columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            order = np.argsort(numbers, kind="stable")
            edges = np.flatnonzero(np.diff(numbers[order])) + 1
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], columns)
            found, packed, held = [], [], 0
            for part in np.split(order, edges):
                sink = pa.BufferOutputStream()
                rows = rest.take(pa.array(part))
                with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
                    stream.write_batch(rows)
                found.append(int(numbers[part[0]]))
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(packed, pa.binary())], ["block", "rows"])
            del rest, found, packed
            make_room()

    return narrow.mapInArrow(deal, "block int, rows binary")


def from_blocks(packed: pa.ChunkedArray) -> pa.Table:
    """The rows of a block, by id and then text, so that their order is the same in every pass."""
    make_room()
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for chunk in packed.chunks for x in chunk]
    rows = pa.concat_tables(tables).combine_chunks()
    names = rows.column_names[:2]
    return rows.sort_by([(n, "ascending") for n in names]).combine_chunks()
