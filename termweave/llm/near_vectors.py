"""Embedding near-duplicates by an exact metric range join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine limit is a radius. Pivots of a label divide
its vectors into cells of the nearest pivot. If a vector is within the radius of another of cell q, the
triangle inequality keeps it within the radius of the plane midway between its own pivot and q, and it
is copied to q; so every vector meets all its partners in its home cell. Cells with many vectors are
split, their members meeting all others of the cell. A cell streams its vectors past its own ones, so
a task holds one bounded piece; it counts links and joins linked vectors into a forest, and no pair
leaves the task.

Vectors link only under equal labels and widths. A null label, a null vector, a null or non-finite
component or a zero vector links with nothing; such rows, and rows without id, come back alone. Repeated
rows link like any equal vectors. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import save, table
from .components import components

#: Vectors of a cell, about, and most pivots of a label.
CELL, PIVOTS = 1024, 256
#: Vectors that one piece of a cell owns, and rows that pass them at once.
PIECE, PASS = 1024, 2048

_FOUND = "id long, n_links long, other long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def assign(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and a table of the cells that it must be copied to."""
    squares = np.maximum(0.0, 2 - 2 * vectors @ pivots.T)
    home = squares.argmin(axis=1)
    own = squares[np.arange(len(vectors)), home]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))[home]
    copy = squares - own[:, None] <= 2 * apart * (radius + 1e-9) + 1e-12
    copy[np.arange(len(vectors)), home] = False
    return home, copy


class Piece:
    """The vectors that one piece owns: their links and a forest over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, cosine: float):
        self.ids, self.vectors, self.norms, self.cosine = ids, vectors, norms, cosine
        self.links = np.full(len(ids), -1, np.int64)  # a vector meets itself once
        self.root = np.arange(len(ids))

    def meet(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> list[tuple[int, int]]:
        """Count links with passing vectors; one edge for each that is linked."""
        near = (self.vectors @ vectors.T) / (self.norms[:, None] * norms[None, :]) >= self.cosine
        self.links += near.sum(axis=1)
        passing, own = np.nonzero(near.T)
        if not len(own):
            return []
        first = np.flatnonzero(np.concatenate(([True], passing[1:] != passing[:-1])))
        while True:
            least = np.repeat(np.minimum.reduceat(self.root[own], first), np.diff(first, append=len(own)))
            merged = np.arange(len(self.ids))
            np.minimum.at(merged, self.root[own], least)
            root = merged[self.root]
            if (root == self.root).all():
                break
            self.root = root
        return list(zip(ids[passing[first]].tolist(), self.ids[own[first]].tolist(), strict=True))

    def found(self) -> list[tuple[int, int | None, int | None]]:
        own = self.ids.tolist()
        return [(i, n, r) for i, n, r in zip(own, self.links.tolist(), self.ids[self.root].tolist(), strict=True)]


def own_piece() -> Column:
    """The piece of its cell that owns a row; repeated rows are dealt like others."""
    return F.pmod(F.xxhash64("id", "row", F.lit(3)), F.col("pieces"))


def range_join(
    vectors: DataFrame, cosine: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(id, n_links, component) of every row."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    slim = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")
    )
    huge = F.lit(float("inf"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists("v", lambda x: x != 0)
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound
    slim = slim.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    good = slim.filter("sound").select("id", "row", F.concat_ws("|", F.size("v").cast("string"), "label").alias("label"), "v")
    sizes = save(good.groupBy("label").agg(F.count("*").alias("n")), "vector-labels")
    sizes = sizes.withColumn("cells", F.least(F.ceil(F.col("n") / CELL), F.lit(PIVOTS)).cast("int"))
    salted = good.join(sizes, "label").withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.ceil(F.col("n") / 4096)).cast("int"))
    # Pivots: the first distinct vectors of each label by hash, over all its rows; at least one.
    hashed = good.withColumn("h", F.xxhash64("v", F.lit(11)))
    order = Window.partitionBy("label").orderBy("h")
    firsts = hashed.select("label", "h").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS)
    pivots = hashed.join(firsts.join(sizes, "label").filter("rank <= cells"), ["label", "h"])
    pivots = save(pivots.groupBy("label", "rank").agg(F.first("v").alias("v"), F.first("n").alias("n")), "vector-pivots")
    spots = F.sequence(F.lit(0), (F.ceil(F.col("n") / 4096) - 1).cast("int"))
    pivots = pivots.select("label", F.explode(spots).alias("salt"), "rank", "v").toDF("label", "salt", "rank", "v")

    def deal(rows: pa.Table, near: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("label", pa.string()), ("cell", pa.int32()), ("home", pa.bool_()), ("id", pa.int64()), ("row", pa.int64()), ("v", pa.binary())]
        )
        if not rows.num_rows:
            return schema.empty_table()
        label = rows.column("label")[0].as_py()
        raw = _matrix(rows.column("v"), int(label.split("|", 1)[0]))
        near = near.sort_by("rank")
        home, copy = assign(_unit(raw), _unit(_matrix(near.column("v"), raw.shape[1])), radius)
        who, where = np.nonzero(copy)
        row, cell = np.concatenate((np.arange(len(raw)), who)), np.concatenate((home, where))
        packed = pa.array([x.tobytes() for x in raw], pa.binary())
        return pa.table(
            [
                pa.array([label] * len(row), pa.string()),
                pa.array(cell.astype(np.int32)),
                pa.array(np.arange(len(row)) < len(raw)),
                rows.column("id").combine_chunks().take(pa.array(row)),
                rows.column("row").combine_chunks().take(pa.array(row)),
                packed.take(pa.array(row)),
            ],
            schema,
        )

    keys = ["label", "salt"]
    dealt = salted.select(*keys, "id", "row", "v").groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInArrow(
        deal, "label string, cell int, home boolean, id long, row long, v binary"
    )
    dealt = save(dealt, "vector-cells")
    owned = dealt.filter("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    own = F.col("home") & (F.col("piece") == own_piece())
    passing = dealt.join(owned, ["label", "cell"]).select("label", "cell", "home", "id", "row", "v", "pieces", every.alias("piece"))
    passing = passing.select("label", "cell", "piece", F.coalesce(own, F.lit(False)).alias("own"), "id", "v")
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passing = passing.repartition(width, "label", "cell", "piece").sortWithinPartitions("label", "cell", "piece", F.desc("own"))
    joined = save(passing.mapInArrow(lambda batches: _stream(batches, cosine), _FOUND), "vector-links")
    links = joined.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    linked = joined.filter("n_links IS NOT NULL").select("id", "n_links")
    alone = slim.filter("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).join(components(links), "id", "left").select(
        "id", "n_links", F.coalesce("component", "id").alias("component")
    )


def _stream(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Pieces come one after the other, each with its own vectors first."""
    schema = pa.schema([("id", pa.int64()), ("n_links", pa.int64()), ("other", pa.int64())])
    key, piece, held = None, None, []

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def close() -> Piece:
        ids, vectors = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        return Piece(ids, vectors, np.linalg.norm(vectors, axis=1), cosine)

    def passes(target: Piece, ids: np.ndarray, vectors: np.ndarray) -> list[tuple]:
        rows = []
        for k in range(0, len(ids), PASS):
            part = vectors[k : k + PASS]
            rows += [(y, None, h) for y, h in target.meet(ids[k : k + PASS], part, np.linalg.norm(part, axis=1))]
        return rows

    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(3)]
        keys = list(zip(*names, strict=True))
        own = batch.column(3).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(keys):
            stop = start
            while stop < len(keys) and keys[stop] == keys[start]:
                stop += 1
            if keys[start] != key:
                if key is not None:
                    if piece is None:
                        piece = close()
                        yield made(passes(piece, piece.ids, piece.vectors))
                    yield made(piece.found())
                key, piece, held = keys[start], None, []
            width = int(key[0].split("|", 1)[0])
            ids = batch.column(4).slice(start, stop - start).to_numpy()
            raw = b"".join(batch.column(5).slice(start, stop - start).to_pylist())
            vectors = np.frombuffer(raw, np.float64).reshape(-1, width)
            mine = own[start:stop]
            if mine.any():
                held.append((ids[mine], vectors[mine]))
            if not mine.all():
                if piece is None:
                    if not held:  # a piece that owns nothing
                        held.append((ids[:0], vectors[:0]))
                    piece = close()
                    yield made(passes(piece, piece.ids, piece.vectors))
                yield made(passes(piece, ids[~mine], vectors[~mine]))
            start = stop
    if key is not None:
        if piece is None:
            piece = close()
            yield made(passes(piece, piece.ids, piece.vectors))
        yield made(piece.found())


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"), 0.98).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
