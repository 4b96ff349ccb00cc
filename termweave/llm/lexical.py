"""Ranked lexical search by MaxScore whose bounds come from term pairs.

Index: texts are cut into shards of some MB where they are read, and a shard is a row for each of its
terms (documents' places in it, occurrences) and one for its documents (ids, numbers of terms; the term is
the empty one, which no text has). Nothing is shuffled, and a frequent term is a row a shard.

Pair lists: terms and items are joined with the index by term and dealt by (shard, block of items). There
the impacts of each term are computed, an item's terms are paired from the most frequent one up, and the
documents of each pair are intersected; a pair list stores the largest joint impact and where it is. A pair
adds at most the largest of its joint maximum and its two own maxima to a score, which is less than
their sum. The documents at the joint maxima are scored, and the k-th best of all shards is
the item's threshold.

Search: in each shard the pairs with the least bounds are left out as long as their sum stays below the
threshold (non-essential); documents of the other lists are summed, and the left-out lists are looked up only for
documents that can still reach the threshold, from the largest bound down. Results are exact; ties
go to the smaller id.

Terms are maximal runs of letters and digits of ASCII and of all characters beyond it; only A-Z are
lowered. A null or empty text has no terms and is no document of the collection; an item without terms
has no results; repeated rows, of documents and of items, are rows of their own; null ids rank after others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, give_back, save, slices, table

TOP = 10
#: Text of a shard, and items that one task handles at once.
SHARD_BYTES = 8 << 20
ITEM_BLOCK = 256

_KEEP = np.full(256, 0x20, np.uint8)
for _byte in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _KEEP[_byte] = _byte + 0x20 if 0x41 <= _byte <= 0x5A else _byte


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All terms of the texts in their order, and the number of each one's text."""
    offsets, raw = buffers(texts)
    cooked = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_KEEP[raw]))
    words = pc.split_pattern(cooked, " ")
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    rows = np.repeat(np.arange(len(texts)), np.diff(np.asarray(words.offsets)))
    return rows[np.asarray(real)], flat.filter(real)


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


_INDEX = "shard long, term string, docs array<int>, counts array<int>, ids array<long>"


def _shard(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    rows, words = terms_of(texts)
    lengths = np.bincount(rows, minlength=len(texts))
    held = np.flatnonzero(lengths)
    place = np.cumsum(lengths > 0) - 1
    coded = words.dictionary_encode()
    found = np.asarray(coded.indices).astype(np.int64) * max(1, len(held)) + place[rows]
    pairs, counts = np.unique(found, return_counts=True)
    codes, docs = np.divmod(pairs, max(1, len(held)))
    ends = np.searchsorted(codes, np.arange(len(coded.dictionary) + 1))
    n = len(coded.dictionary) + 1
    documents = pa.ListArray.from_arrays(
        pa.array([0] * n + [len(held)], pa.int32()), ids.take(pa.array(held)).cast(pa.int64())
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, number)),
            pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])]),
            _lists(np.append(ends, len(docs)), docs, pa.int32()),
            _lists(np.append(ends, len(docs) + len(held)), np.concatenate((counts, lengths[held])), pa.int32()),
            documents,
        ],
        ["shard", "term", "docs", "counts", "ids"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents (shard, term, docs, counts, ids), written below the shared folder."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text_col, shard_bytes):
                yield _shard(number, part.column(id_col), part.column(text_col))
                number += 1

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return save(narrow.mapInArrow(build, _INDEX), "index")


def collection(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    own = index.filter("term = ''").select(F.size("ids").alias("n"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    found = own.agg(F.sum("n"), F.sum("l")).first()
    return int(found[0] or 0), int(found[1] or 0)


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(item, term) of a table (item, text), each once."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = terms_of(batch.column(text_col))
            own = batch.column("item").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own, words.cast(pa.string())], ["item", "term"])

    return items.select("item", text_col).mapInArrow(cut, "item long, term string").distinct()


def impacts(weight: int, counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.int64)
    return weight * (1_000_000_000 * counts // (1000 * counts + 8 * norms))


def norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's length against the mean; exact where the product passes 64 bits."""
    if len(lengths) and 90 * int(lengths.max()) * documents >= 1 << 63:
        return np.array([10 + 90 * int(n) * documents // terms for n in lengths], np.int64)
    return 10 + 90 * lengths.astype(np.int64) * documents // max(1, terms)


class Lists:
    """A shard's posting lists for a block of items, with pair lists.

    ``docs`` and ``impacts`` by term, falling with the term's frequency; ``pairs`` maps two terms to their largest joint impact
    and its document; ``items`` maps an item to its terms.
    """

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray], items: dict[int, list[int]], size: int):
        self.docs, self.impacts, self.items, self.size = docs, impacts, items, size
        self.most = [int(x.max()) for x in impacts]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}

    def intersect(self) -> None:
        """Fill the pair lists of all items."""
        wanted: dict[int, set[int]] = {}
        for terms in self.items.values():
            for a, b in zip(terms[::2], terms[1::2], strict=False):
                wanted.setdefault(a, set()).add(b)
        dense = np.zeros(self.size, np.int64)
        for a, others in wanted.items():
            dense[self.docs[a]] = self.impacts[a]
            for b in others:
                joint = dense[self.docs[b]]
                joint = np.where(joint > 0, joint + self.impacts[b], 0)
                best = int(joint.argmax())
                self.pairs[a, b] = int(joint[best]), int(self.docs[b][best])
            dense[self.docs[a]] = 0

    def units(self, item: int) -> list[tuple[int, tuple[int, ...]]]:
        """(bound, terms) of the item's pairs and its odd term, rising by bound."""
        terms = self.items[item]
        found = []
        for a, b in zip(terms[::2], terms[1::2], strict=False):
            found.append((max(self.most[a], self.most[b], self.pairs[a, b][0]), (a, b)))
        if len(terms) % 2:
            found.append((self.most[terms[-1]], (terms[-1],)))
        return sorted(found)

    def add(self, term: int, docs: np.ndarray, scores: np.ndarray) -> None:
        """Add the term's impacts to the scores of some documents (rising)."""
        own = self.docs[term]
        at = np.searchsorted(own, docs)
        at[at == len(own)] = 0
        hit = own[at] == docs
        scores[hit] += self.impacts[term][at[hit]]

    def seeds(self, item: int, top: int) -> np.ndarray:
        """Scores of the documents at the maxima of the item's lists, the best ``top``."""
        terms = self.items[item]
        found = {self.pairs[p][1] for p in zip(terms[::2], terms[1::2], strict=False) if self.pairs[p][0]}
        found |= {int(self.docs[t][self.impacts[t].argmax()]) for t in terms[-1:]}
        docs = np.array(sorted(found))
        scores = np.zeros(len(docs), np.int64)
        for t in terms:
            self.add(t, docs, scores)
        return np.sort(scores)[::-1][:top]

    def search(self, item: int, threshold: int, top: int, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of at least ``threshold`` that can be among the best ``top``, and their scores."""
        units = self.units(item)
        bounds = np.cumsum([0] + [u[0] for u in units])
        skipped = int(np.searchsorted(bounds, threshold, side="left")) - 1  # units whose sum is below the threshold
        acc = np.zeros(self.size, np.int64)
        for _, terms in units[skipped:]:
            for t in terms:
                acc[self.docs[t]] += self.impacts[t]
        docs = np.flatnonzero(acc + bounds[skipped] >= threshold) if skipped < len(units) else np.zeros(0, np.int64)
        scores = acc[docs]
        if seen is not None:
            seen["summed"] = seen.get("summed", 0) + sum(len(self.docs[t]) for _, terms in units[skipped:] for t in terms)
            seen["all"] = seen.get("all", 0) + sum(len(self.docs[t]) for _, terms in units for t in terms)
        for k in range(skipped - 1, -1, -1):
            if len(scores) > top:
                threshold = max(threshold, int(np.partition(scores, -top)[-top]))
            able = scores + bounds[k + 1] >= threshold
            docs, scores = docs[able], scores[able]
            for t in units[k][1]:
                self.add(t, docs, scores)
        good = (scores >= threshold) & (scores > 0)
        return docs[good], scores[good]


def _packed(tables: list[pa.Table]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for t in tables:
            stream.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _split(lists: pa.ChunkedArray) -> list[np.ndarray]:
    whole = lists.combine_chunks()
    offsets, values = np.asarray(whole.offsets), np.asarray(whole.values)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


_PAIRED = "shard long, part int, size int, lists binary, pairs binary, ids array<long>, seeds array<struct<item:long,score:long>>"


def pair_lists(index: DataFrame, terms: DataFrame, documents: int, all_terms: int, top: int) -> DataFrame:
    """One row for each shard and block of items: posting lists with impacts, pair lists, seeds."""

    def pair(rows: pa.Table) -> pa.Table:
        give_back()
        rows = rows.combine_chunks()
        own = pc.equal(rows.column("term"), "")
        head, rows = rows.filter(own), rows.filter(pc.invert(own)).sort_by([("df", "descending"), ("term", "ascending")])
        lengths = np.concatenate(_split(head.column("counts")))
        norm = norms(lengths, documents, all_terms)
        docs, counts = _split(rows.column("docs")), _split(rows.column("counts"))
        impact = [impacts(w, c, norm[d]) for w, c, d in zip(rows.column("weight").to_pylist(), counts, docs, strict=True)]
        items: dict[int, list[int]] = {}
        for t, found in enumerate(rows.column("items").to_pylist()):
            for item in found:
                items.setdefault(item, []).append(t)
        lists = Lists(docs, impact, items, len(lengths))
        lists.intersect()
        seeds = [{"item": i, "score": int(s)} for i in items for s in lists.seeds(i, top) if s > 0]
        ends = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.int64)))
        flat = (lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64))
        packed = pa.table(
            {"items": rows.column("items").combine_chunks(), "docs": _lists(ends, flat(docs), pa.int32()), "impacts": _lists(ends, flat(impact), pa.int64())}
        )
        keys, values = np.array(list(lists.pairs), np.int32).reshape(-1, 2), np.array(list(lists.pairs.values()), np.int64).reshape(-1, 2)
        pairs = pa.table({"a": keys[:, 0], "b": keys[:, 1], "joint": values[:, 0], "doc": values[:, 1]})
        return pa.table(
            {
                "shard": head.column("shard"),
                "part": head.column("part"),
                "size": pa.array([len(lengths)], pa.int32()),
                "lists": pa.array([_packed([packed])], pa.binary()),
                "pairs": pa.array([_packed([pairs])], pa.binary()),
                "ids": head.column("ids"),
                "seeds": pa.array([seeds], pa.list_(pa.struct([("item", pa.int64()), ("score", pa.int64())]))),
            }
        )

    joined = index.join(terms, "term").select("shard", "part", "term", "docs", "counts", "ids", "items", "df", "weight")
    return save(joined.groupBy("shard", "part").applyInArrow(pair, _PAIRED), "pairs")


def search(
    index: DataFrame, items: DataFrame, top: int = TOP, item_col: str = "item_id", text_col: str = "text", item_block: int = ITEM_BLOCK
) -> DataFrame:
    """(item, ``item_col``, rank, doc_id, score): the best ``top`` documents of every row of ``items``."""
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("name"), F.col(text_col).cast("string").alias("text"))
    asked = save(asked, "items")
    documents, all_terms = collection(index)
    terms = save(item_terms(asked, "text"), "terms")
    parts = max(1, -(-asked.count() // item_block))
    terms = terms.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    words = terms.select("term").distinct()
    df = index.join(words, "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    by_part = terms.groupBy("part", "term").agg(F.collect_list("item").alias("items")).join(df, "term")
    heads = terms.select("part").distinct().select(
        F.lit("").alias("term"), "part", F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("weight")
    )
    by_part = save(by_part.select("term", "part", "items", "df", weight.alias("weight")).union(heads), "by_part")
    paired = pair_lists(index, by_part, documents, all_terms, top)
    seeds = paired.select(F.explode("seeds").alias("s")).select("s.item", "s.score")
    best = seeds.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    floors = best.filter(F.col("r") <= top).groupBy("item").agg(F.min("score").alias("score"), F.max("r").alias("n"))
    floors = floors.filter(F.col("n") == top).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    floors = save(floors.groupBy("part").agg(F.collect_list(F.struct("item", "score")).alias("floors")), "floors")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _found({c: batch.column(c)[row] for c in batch.schema.names}, top)
            give_back()

    hits = paired.drop("seeds", "shard").join(floors, "part", "left").drop("part").mapInArrow(find, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("item", F.col("name").alias(item_col)), "item").select("item", item_col, "rank", "doc_id", "score")


def _found(row: dict[str, pa.Scalar], top: int) -> pa.RecordBatch:
    """The best documents of one shard for one block of items."""
    packed, pairs = _unpacked(row["lists"]), _unpacked(row["pairs"])
    items: dict[int, list[int]] = {}
    for t, found in enumerate(packed.column("items").to_pylist()):
        for item in found:
            items.setdefault(item, []).append(t)
    lists = Lists(_split(packed.column("docs")), _split(packed.column("impacts")), items, row["size"].as_py())
    for a, b, joint, doc in zip(*(c.to_pylist() for c in pairs.columns), strict=True):
        lists.pairs[a, b] = joint, doc
    floors = {f["item"]: f["score"] for f in row["floors"].as_py() or []}
    ids = row["ids"].values
    named = np.asarray(pc.fill_null(ids, np.iinfo(np.int64).max))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for item in items:
        docs, scores = lists.search(item, floors.get(item, 1), top)
        order = np.lexsort((named[docs], -scores))[:top]
        out.append((np.full(len(order), item), docs[order], scores[order]))
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ([], [], []))]
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), ids.take(pa.array(columns[1])), pa.array(columns[2])], ["item", "doc_id", "score"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")
