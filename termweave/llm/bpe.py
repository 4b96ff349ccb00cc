"""Byte-level BPE by replaying the merges over all words of a task at once.

The distinct words of a slice of texts lie in one array of symbols. An inverted index leads from a token
pair (named by the rank of its merge) to the positions where it stands; merges are applied in rank
order, each to all its positions together, and only the neighbours of a merged pair are looked up
again. A worker remembers the ids of the words it has met, up to a bound.

Texts are whole; a null text is empty and has no ids; an empty table gives an empty result; repeated
rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table
from .tokens import Encoder

#: Text whose words are merged together.
CORPUS_BYTES = 32 << 20
_BUILT: dict[tuple[str, str], MergeEncoder] = {}


class Merges:
    """Ranks of a vocabulary file, and for every pair of tokens that merges, the result."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (left * size + right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.size, self.keys, self.made = size, np.append(keys[order], np.iinfo(np.int64).max), np.append(made[order], -1).astype(np.int32)
        # A token that takes part in a merge of lower rank: its merges must be replayed one by one.
        self.alone = np.zeros(size, bool)
        for part in (keys // size, keys % size):
            self.alone[part[made < part]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def replay(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has; words are given by their bytes and lengths."""
        n = len(raw)
        symbol = self.of_byte[raw]
        word = np.repeat(np.arange(len(lengths)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            turn = np.flatnonzero(word[1:] != word[:-1])
            after[turn], after[-1] = -1, -1
            before[turn + 1] = -1
        live = np.ones(n, bool)
        now = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        now[inner] = self.rank(symbol[inner], symbol[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = now[places]
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *edges.tolist(), len(places)]
            for rank, a, b in zip(ranks[starts[:-1]].tolist(), starts[:-1], starts[1:], strict=True):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(queue, rank)

        enter(inner)
        while queue:
            rank = heapq.heappop(queue)
            found = index.pop(rank)
            places = np.unique(np.concatenate(found))
            places = places[now[places] == rank]
            if not len(places):
                continue
            if self.alone[rank]:  # the leftmost of each word; the others wait
                first = np.concatenate(([True], word[places[1:]] != word[places[:-1]]))
                if not first.all():
                    index[rank] = [places[~first]]
                    heapq.heappush(queue, rank)
                    places = places[first]
            elif len(places) > 1:  # of overlapping pairs every second, from the left
                meets = after[places[:-1]] == places[1:]
                if meets.any():
                    number = np.arange(len(places))
                    begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~meets)), number, 0))
                    places = places[(number - begin) % 2 == 0]
            gone = after[places]
            next_ = after[gone]
            symbol[places] = rank
            live[gone] = False
            now[gone] = -1
            after[places] = next_
            has = next_ >= 0
            before[next_[has]] = places[has]
            now[places] = -1
            left = before[places]
            left = left[left >= 0]
            touched = np.concatenate((places[has], left))
            if len(touched):
                now[touched] = self.rank(symbol[touched], symbol[after[touched]])
                enter(touched)
        return symbol[live], np.bincount(word[live], minlength=len(lengths))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class MergeEncoder(Encoder):
    """Whole texts to ids: words by the pattern, ids by :class:`Merges`."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.words_of = regex.compile(pattern).findall
        self.blank = True
        self._reset()

    def _ids(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lists = self._one_by_one(words)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return words, np.fromiter((i for x in lists for i in x), np.int32, int(counts.sum())), counts

    def _one_by_one(self, texts: list[str]) -> list[list[int]]:
        number: dict[str, int] = {}
        lists = [[number.setdefault(w, len(number)) for w in self.words_of(t)] for t in texts]
        known: dict[int, list[int]] = {}
        todo: list[bytes] = []
        places: list[int] = []
        for word, at in number.items():
            raw = word.encode()
            rank = self.merges.ranks.get(raw)
            if rank is not None:
                known[at] = [rank]
            else:
                todo.append(raw)
                places.append(at)
        lengths = np.fromiter(map(len, todo), np.int64, len(todo))
        ids, counts = self.merges.replay(np.frombuffer(b"".join(todo), np.uint8), lengths)
        ends = [0, *np.cumsum(counts).tolist()]
        flat = ids.tolist()
        for at, a, b in zip(places, ends[:-1], ends[1:], strict=True):
            known[at] = flat[a:b]
        return [known[x[0]] if len(x) == 1 else [i for w in x for i in known[w]] for x in lists]


def merge_encoder(path: str, pattern: str) -> MergeEncoder:
    """The worker's encoder for one rank file."""
    if (path, pattern) not in _BUILT:
        _BUILT[path, pattern] = MergeEncoder(path, pattern)
    return _BUILT[path, pattern]


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Per row: the id, number of ids, digest of the ids, digest of the decoded bytes; the ids on demand."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merge_encoder(path, pattern)
        names = [str(i) for i in range(own.merges.size)]
        for whole in batches:
            for part in slices(whole, text_col, CORPUS_BYTES):
                flat, ends = own.encode(part.column(text_col))
                said, told, lists = [], [], []
                for row in range(part.num_rows):
                    ids = flat[ends[row] : ends[row + 1]]
                    said.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                    told.append(hashlib.sha256(own.merges.decode(ids)).hexdigest())
                    if keep_ids:
                        lists.append(ids.tolist())
                columns = [part.column(id_col), pa.array(np.diff(ends)), pa.array(said, pa.string()), pa.array(told, pa.string())]
                labels = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, labels)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
