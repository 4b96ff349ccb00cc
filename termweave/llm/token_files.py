"""Token-id files: independent zstandard frames, a trailing seek table and a checksum per frame.

Layout of a file: frames of little-endian ids, each a zstandard frame of its own with content checksum;
a skippable frame with the document index (ids, number of ids, first document of each frame, null ids); a
skippable frame with the seek table of the zstandard seekable format (compressed size, size and
checksum of each frame). Any zstandard tool reads the ids as one stream; a reader that wants a few
documents reads both tables from the end of the file and decompresses only the frames it needs.

Documents are written in ascending id order, null ids first, ties by the hash of the text. Files are cut by
(id, hash, row), so many rows of one id, or without one, are spread over files like others. A null text has the end id
alone, an empty table gives no file, repeated rows are written again, other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import scratch_path
from .common import save, slices, table
from .tokens import encoder, with_end

# Fixed values of the zstandard format: skippable frames, seekable footer.
SKIP_INDEX, SKIP_SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

#: Ids that one frame holds, about; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
_TAIL = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])

MANIFEST = "part int, file string, n_docs long, n_ids long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows: local, HDFS, S3, GCS."""
    return pafs.FileSystem.from_uri(path)


class TokenWriter:
    """Appends documents to one file; ids take two bytes while the vocabulary allows it."""

    def __init__(self, stream, wide: bool, level: int = 3, frame_ids: int = FRAME_IDS):
        self.stream, self.kind = stream, np.dtype("<u4" if wide else "<u2")
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_ids, self.waiting, self.held = frame_ids, [], 0
        self.entries: list[tuple[int, int, int]] = []
        self.counts: list[int] = []
        self.ids: list[int | None] = []
        self.firsts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.waiting and self.held + len(ids) > self.frame_ids:
            self._flush()
        if not self.waiting:
            self.firsts.append(len(self.counts))
        self.waiting.append(ids)
        self.held += len(ids)
        self.counts.append(len(ids))
        self.ids.append(doc_id)

    def _flush(self) -> None:
        raw = np.concatenate(self.waiting).astype(self.kind).tobytes()
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index = struct.pack("<BQ", self.kind.itemsize, len(self.counts))
        index += zstandard.ZstdCompressor(level=3).compress(
            np.array([i or 0 for i in self.ids], "<i8").tobytes()
            + np.array(self.counts, "<u4").tobytes()
            + np.array(self.firsts, "<u4").tobytes()
            + np.packbits(np.array([i is None for i in self.ids], bool)).tobytes()
        )
        self.stream.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        seek = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<I", len(index))
        seek += _TAIL.pack(len(self.entries), 0x80, FOOTER)
        self.stream.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)


class TokenReader:
    """Random access to one file: only the tables and the frames asked for are read."""

    def __init__(self, stream, size: int):
        self.stream = stream
        n, _, magic = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        if magic != FOOTER:
            raise ValueError("no seek table at the end of the file")
        table_at = size - _TAIL.size - 4 - n * _ENTRY.itemsize
        raw = self._at(table_at, n * _ENTRY.itemsize + 4)
        self.entries = np.frombuffer(raw[:-4], _ENTRY)
        index_size = struct.unpack("<I", raw[-4:])[0]
        index = self._at(table_at - 8 - index_size, index_size)
        width, docs = struct.unpack("<BQ", index[:9])
        size = docs * 12 + n * 4 + -(-docs // 8)
        tables = zstandard.ZstdDecompressor().decompress(index[9:], max_output_size=size) if docs else b""
        self.kind = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(tables, "<i8", docs)
        self.counts = np.frombuffer(tables, "<u4", docs, docs * 8).astype(np.int64)
        self.firsts = np.append(np.frombuffer(tables, "<u4", n, docs * 12), docs).astype(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(tables, np.uint8, -(-docs // 8), docs * 12 + n * 4), count=docs).astype(bool)
        self.places = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def frame(self, number: int) -> np.ndarray:
        """The ids of one frame; both checksums must hold."""
        entry = self.entries[number]
        raw = zstandard.ZstdDecompressor().decompress(
            self._at(int(self.places[number]), int(entry["packed"])), max_output_size=int(entry["size"])
        )
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(raw, self.kind)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, ids before it in the file and ids of all documents, or of the wanted ones."""
        starts = np.concatenate(([0], np.cumsum(self.counts)))
        asked = None if wanted is None else np.isin(self.ids, np.array(sorted(wanted), np.int64)) & ~self.nulls
        for number in range(len(self.entries)):
            first, stop = self.firsts[number], self.firsts[number + 1]
            if asked is not None and not asked[first:stop].any():
                continue
            ids = self.frame(number)
            for doc in range(first, stop):
                if asked is None or asked[doc]:
                    own = None if self.nulls[doc] else int(self.ids[doc])
                    at = starts[doc] - starts[first]
                    yield own, int(starts[doc]), ids[at : at + self.counts[doc]]


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", level: int = 3
) -> DataFrame:
    """Encode all documents into token files below the shared folder; returns the files in order.

    A range partition of (id, hash of the text, row) is one file. The file's name is new in every attempt and becomes valid
    by its row in the returned manifest, so lost executors and second attempts leave no false data.
    """
    base = scratch_path(docs.sparkSession, "tokens")
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = [F.col("id"), F.xxhash64("text"), F.col("row")]
    ranged = ranged.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.drop("row")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sink, writer = encoder(tokenizer), None, None
        path, total = f"{base}/{uuid.uuid4().hex}.ids.zst", 0
        for whole in batches:
            for part in slices(whole, "text"):
                if writer is None:
                    fs, place = _open(path)
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(place, compression=None)
                    writer = TokenWriter(sink, own.tokenizer.get_vocab_size() > 1 << 16 or end_id >> 16 > 0, level)
                flat, ends = with_end(*own.encode(part.column("text")), end_id)
                total += len(flat)
                for row, doc_id in enumerate(part.column("id").to_pylist()):
                    writer.add(doc_id, flat[ends[row] : ends[row + 1]])
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "file": path, "n_docs": len(writer.counts), "n_ids": total}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    return save(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files: id, ids before it in all files, number of ids, crc and the ids themselves.

    One task reads one file and holds one frame. ``wanted``: a bounded list of ids, for random access.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
    asked = None if wanted is None else set(wanted)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                fs, place = _open(file)
                with fs.open_input_file(place) as stream:
                    rows, held = [], 0
                    for doc_id, start, ids in TokenReader(stream, stream.size()).documents(asked):
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(raw), raw))
                        held += len(raw)
                        if held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                    if rows:
                        yield made(rows)

    spread = files.repartition(max(1, manifest.count()), "part").select("file", "before")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encode_bytes(documents: Iterable[tuple[int, np.ndarray]], wide: bool = False) -> bytes:
    """A file in memory, for small inputs."""
    stream = io.BytesIO()
    writer = TokenWriter(stream, wide)
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    return stream.getvalue()


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest).drop("ids")
