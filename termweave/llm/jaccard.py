"""Near-duplicate texts by a chosen-path Jaccard join over word shingles.

Texts with equal shingle sets form a class, and classes are compared. A class has a signature of
``TOKENS`` minwise tokens, two of which agree as often as their sets overlap. A run of the join splits
all classes on a few sampled positions: classes with the same token there stay together. Buckets that
are still large are split again on positions that their own path samples, up to ``DEPTH`` times; small
ones are compared all with all by signature. Runs are repeated until a pair at the threshold is met
with the probability ``recall``; the number follows from the branching process of the path.

What the runs propose is only a candidate: components of candidates are handed to tasks, and there all
pairs of a component are verified exactly on the shingle sets, so links between members that no run
has brought together are found too. Large components are cut in chunks and every pair of chunks is a
task of bounded size. Tasks count links and keep a forest; no pair leaves them.

A text has the shingles of five words in a row; a shorter one has itself as its only shingle, an empty
or null one has none and links with nothing. Rows without id link with nothing and have no component.
Repeated rows are members of one class. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, block_of, from_blocks, save, slices, table, to_blocks
from .components import components

WORDS, TOKENS, DEPTH = 5, 64, 3
#: Classes of a bucket that are compared at once; larger buckets are split.
SMALL = 64
#: Classes and shingles of a chunk of a component.
CHUNK, CHUNK_SHINGLES = 1024, 4 << 20
BLOCK_BYTES = 2 << 20

_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def runs_needed(threshold: float, recall: float, depth: int = DEPTH, tokens: int = TOKENS, least: int = 0) -> int:
    """Runs after which a pair at the threshold has met in a bucket with probability ``recall``.

    A pair lives through one more split if one of its common tokens is sampled and lives on from there.
    How many tokens are common varies; pairs with fewer than ``least`` are lost in every run alike.
    """
    chance, lives = 1 / (threshold * tokens), np.ones(tokens + 1)
    common = np.arange(tokens + 1)
    for _ in range(depth):
        lives = 1 - (1 - chance * lives) ** common
    lives[:least] = 0.0
    share, runs = common_tokens(threshold, tokens), 1
    if share[:least].sum() >= 1 - recall:
        raise ValueError(f"no number of runs reaches {recall} with {least} common tokens asked for")
    while (share * (1 - lives) ** runs).sum() > 1 - recall:
        runs += 1
    return runs


def common_tokens(threshold: float, tokens: int = TOKENS) -> np.ndarray:
    """Probabilities that a pair at the threshold has 0, 1, ... common tokens."""
    return np.array([math.comb(tokens, k) * threshold**k * (1 - threshold) ** (tokens - k) for k in range(tokens + 1)])


def least_common(threshold: float, recall: float, tokens: int = TOKENS) -> int:
    """Common tokens that all but a hundredth of the loss left by ``recall`` have at the threshold."""
    return max(1, int(np.searchsorted(np.cumsum(common_tokens(threshold, tokens)), (1 - recall) / 100)))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    firsts = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[np.asarray(coded.indices)] if len(coded.indices) else np.zeros(0, np.uint64)
    counts = np.diff(firsts)
    counts[np.asarray(pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0))] = 0
    starts = firsts[:-1] - firsts[0]
    n = len(hashes) - words + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(words):
        out += _mix(hashes[k : k + max(n, 0)] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    out = _mix(out)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(counts - words + 1, 0)) - np.maximum(counts - words + 1, 0), np.maximum(counts - words + 1, 0))
    values = out[np.repeat(starts, np.maximum(counts - words + 1, 0)) + inner]
    for row in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        own = hashes[starts[row] : starts[row] + counts[row]]
        doc = np.append(doc, row)
        values = np.append(values, np.uint64(xxhash.xxh64_intdigest(own.tobytes())))
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[fresh], values[fresh]
    return values, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(counts)))))


def signatures(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minwise tokens (rows of 32-bit numbers) of sets that are not empty."""
    out = np.empty((len(ends) - 1, TOKENS), np.uint32)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat(((values * _ODD[k]) >> np.uint64(32)).astype(np.uint32), ends[:-1])
    return out


def _described(docs: DataFrame) -> DataFrame:
    """(id, key, size, tokens) of every row with shingles; equal keys are equal sets."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                values, ends = shingles(part.column("text"))
                rows = np.flatnonzero(np.diff(ends))
                if not len(rows):
                    continue
                tokens = signatures(values, np.append(ends[rows], len(values)))
                keys = [xxhash.xxh3_128_digest(values[ends[r] : ends[r + 1]].tobytes()) for r in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows)),
                        pa.array(keys, pa.binary()),
                        pa.array(np.diff(ends)[rows]),
                        pa.array([t.tobytes() for t in tokens], pa.binary()),
                    ],
                    ["id", "key", "size", "tokens"],
                )

    return docs.mapInArrow(describe, "id long, key binary, size long, tokens binary")


def _split(paths: np.ndarray, tokens: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and new paths: each path samples its positions, and the token there extends it."""
    limit = np.uint64(min(chance, 1.0) * 2.0**64 * (1 - 2**-53))
    rows, made = [], []
    for k in range(tokens.shape[1]):
        drawn = _mix(paths + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        hit = np.flatnonzero(drawn < limit)
        if len(hit):
            rows.append(hit)
            made.append(_mix(drawn[hit] ^ _mix(tokens[hit, k].astype(np.uint64) + np.uint64(1))))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(made)) if rows else (empty, empty.astype(np.uint64))


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _splitter(chance: float, runs: int = 0) -> Callable:
    """A pass that extends paths by one position; with ``runs`` it begins them."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, ids = _tokens(batch.column("tokens")), batch.column("id").to_numpy()
            if runs:
                starts = [np.full(len(ids), _mix(np.array([r + 1], np.uint64))[0]) for r in range(runs)]
            else:
                starts = [batch.column("path").to_numpy().view(np.uint64)]
            for paths in starts:
                rows, made = _split(paths, tokens, chance)
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(ids[rows])], ["path", "id"])

    return split


def _compare(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket whose signatures agree in ``least`` positions; buckets come one after the other."""
    held: tuple | None = None
    for batch in batches:
        path, ids, tokens = batch.column("path").to_numpy(), batch.column("id").to_numpy(), _tokens(batch.column("tokens"))
        if held is not None:
            path, ids, tokens = (np.concatenate(x) for x in zip(held, (path, ids, tokens), strict=True))
        last = np.flatnonzero(path != path[-1]) if len(path) else path
        cut = int(last[-1]) + 1 if len(last) else 0
        held = (path[cut:], ids[cut:], tokens[cut:])
        yield from _pairs(path[:cut], ids[:cut], tokens[:cut], least)
    if held is not None:
        yield from _pairs(*held, least)


def _pairs(path: np.ndarray, ids: np.ndarray, tokens: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    for step in range(1, SMALL):
        at = np.flatnonzero(path[step:] == path[:-step])
        if not len(at):
            return
        near = at[(tokens[at] == tokens[at + step]).sum(axis=1) >= least]
        if len(near):
            yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(ids[near + step])], ["a", "b"])


def candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) between classes that the runs propose."""
    least, chance = least_common(threshold, recall), 1 / (threshold * TOKENS)
    runs = runs_needed(threshold, recall, least=least)
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signs = classes.select("id", "tokens")
    found: DataFrame | None = None
    now = save(signs.mapInArrow(_splitter(chance, runs), "path long, id long"), "paths")
    for depth in range(1, DEPTH + 1):
        sizes = now.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
        shared = save(now.join(sizes, "path"), "paths")
        small = shared.filter(F.col("n") <= SMALL).select("path", "id").join(signs, "id")
        small = small.repartition(width, "path").sortWithinPartitions("path", "id").select("path", "id", "tokens")
        links = small.mapInArrow(lambda batches: _compare(batches, least), "a long, b long")
        large = shared.filter(F.col("n") > SMALL)
        if depth == DEPTH:  # these agree in every sampled position; whether they are similar is verified later
            links = links.union(large.select(F.col("id"), F.col("first")).filter("id <> first"))
        links = save(links.distinct(), "proposed")
        found = links if found is None else found.union(links)
        if depth < DEPTH:
            now = save(large.select("path", "id").join(signs, "id").select("path", "id", "tokens").mapInArrow(_splitter(chance), "path long, id long"), "paths")
    return found


def _link_groups(sets: list[np.ndarray], sides: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets are similar; with two sides only pairs across them are asked for."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, doc = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, doc = values[order], doc[order]
    number = np.cumsum(np.concatenate(([0], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    number, doc = np.unique(number[several], return_inverse=True)[1], doc[several]
    common = np.zeros((m, m), np.float64)
    width = max(256, (8 << 20) // max(1, m) // 4)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [start, start + width])
        has = np.zeros((m, min(width, int(number[b - 1]) - start + 1)), np.float32)
        has[doc[a:b], number[a:b] - start] = 1
        common += has @ has.T
    near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    near[np.arange(m), np.arange(m)] = False
    if sides.any():
        near &= sides[:, None] != sides[None, :]
    return near


def _verify(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links and a forest of every task (component, chunk, chunk), one task after the other."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def close(rows: list[tuple]) -> pa.RecordBatch:
        ids, copies = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        near = _link_groups([np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[2] for r in rows]), threshold)
        root = np.arange(len(ids))
        while True:
            around = np.where(near, root[None, :], len(ids)).min(axis=1)
            merged = np.arange(len(ids))
            np.minimum.at(merged, root, np.minimum(around, root))
            if (merged[root] == root).all():
                break
            root = merged[root]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ copies), pa.array(ids[root])], schema=schema)

    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for comp, a, b, *row in zip(*columns, strict=True):
            if (comp, a, b) != key:
                if rows:
                    yield close(rows)
                key, rows = (comp, a, b), []
            rows.append(row)
    if rows:
        yield close(rows)


def similarity_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """(id, class_id, n_links, component) of every row.

    ``class_id`` is the smallest id with the same shingle set, ``n_links`` counts the other rows at or
    above the threshold, ``component`` is the smallest id that links reach.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = save(_described(slim.filter("id IS NOT NULL")), "shingled")
    classes = rows.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    classes = save(classes, "classes")
    groups = save(components(candidates(classes, threshold, recall)), "groups")
    members = groups.join(classes.select("id", "copies", "size"), "id")
    weight = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    )
    n = block_count(slim, "text", BLOCK_BYTES)
    asked = members.join(weight, "component").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("chunks")).cast("int"))
    asked = asked.select(block_of(F.col("id"), n).alias("block"), "id", "component", "copies", "chunk", "chunks")
    blocks = to_blocks(slim, ["id", "text"], n, "id", "text", level=9)

    def fetch(docs_: pa.Table, wanted: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("component", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()), ("shingles", pa.binary())]
        )
        if not docs_.num_rows or not wanted.num_rows:
            return schema.empty_table()
        own = from_blocks(docs_.column("rows"))
        ids = pc.fill_null(own.column(0), np.iinfo(np.int64).min).to_numpy()
        asked_ids = wanted.column("id").to_numpy()
        first = np.unique(ids, return_index=True)
        known = dict(zip(first[0].tolist(), first[1].tolist(), strict=True))
        keep = [i for i, x in enumerate(asked_ids.tolist()) if x in known]
        texts = own.column(1).take(pa.array([known[int(asked_ids[i])] for i in keep], pa.int64()))
        values, ends = shingles(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        packed = [values[ends[i] : ends[i + 1]].tobytes() for i in range(len(keep))]
        taken = wanted.take(pa.array(keep, pa.int64()))
        return pa.table([taken.column(c) for c in ("component", "chunk", "chunks", "id", "copies")] + [pa.array(packed, pa.binary())], schema)

    sets = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        fetch, "component long, chunk int, chunks int, id long, copies long, shingles binary"
    )
    # Chunk c of a component of k chunks takes part in the tasks (c, c) to (c, k - 1) and (0, c) to (c - 1, c).
    spot = F.sequence(F.lit(0), F.col("chunks") - 1)
    sets = sets.select("*", F.explode(spot).alias("mate"))
    a, b = F.least("chunk", "mate").alias("a"), F.greatest("chunk", "mate").alias("b")
    tasks = sets.select("component", a, b, "id", "copies", ((F.col("chunk") > F.col("mate"))).cast("int").alias("side"), "shingles")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks.repartition(width, "component", "a", "b").sortWithinPartitions("component", "a", "b")
    verified = save(tasks.mapInArrow(lambda batches: _verify(batches, threshold), "id long, links long, other long"), "verified")
    final = components(verified.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.select("key", F.col("id").alias("class_id"), "copies").join(links, F.col("class_id") == links["id"], "left").drop("id")
    told = told.join(final, F.col("class_id") == final["id"], "left").select(
        "key", "class_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "class_id").alias("component"),
    )
    known = rows.select("id", "key").join(told, "key").select("id", "class_id", "n_links", "component")
    others = slim.join(rows.select("id").distinct(), "id", "left_anti").select(
        "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")
    )
    return known.unionByName(others)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "class_id",
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
