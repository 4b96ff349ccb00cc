"""Prefix trie of conversations in balanced parentheses, by shards whose spines merge.

A conversation is a path of turn digests (16 bytes a turn). The paths are dealt in order, so a subtree is a
stretch of them, and cut into shards of a bounded number of turns. A shard writes its trie as
parentheses; blocks of excess with their minima and maxima find the close of each open, which delimits the
subtree: ranks count its leaf pairs, and differences of cumulative arrays its members and savings.

Only the nodes on the first and the last path of a shard (its spines) can go on in other shards. A
shard hands them on as two paths, which carry for each depth what hangs there outside the spines, and
the paths of all shards are dealt and cut again, until one shard is left. A node is final in the first round in which it is on
no spine. Conversations that end on a spine hand on their ids as one text a shard, and the texts of a node
are hashed one after the other.

Turns are ordered by number (null first), then by the digest of role and text; a null role or text is
empty; a row without a conversation's id belongs to none and is left out; a repeated row is a turn
of its own; an empty table has no nodes, not even the root; other columns are ignored. ``c % 20`` has the sign of ``c``.
One conversation, as one text elsewhere, is one row: 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running_totals
from .common import give_back, ragged, save, table

#: Turns of a shard, about; a shard holds at least some paths, so that rounds end.
SHARD_TURNS = 200_000
LEAST_PATHS = 8
#: Turns that a conversation takes from its family's first one at most, and the size of a family.
HEADS, FAMILY = 4, 20
_BLOCK = 64
_NONE = np.iinfo(np.int64).max
_VALUES = ["ends", "least", "children", "leaves", "saved"]
_EMPTY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """Balanced parentheses with blocks of excess under a tree of their minima and maxima."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(bits) // _BLOCK)
        padded = np.full(blocks * _BLOCK, int(self.excess[-1]), np.int64)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(blocks, _BLOCK)
        self.low, self.high = [self.blocks.min(axis=1)], [self.blocks.max(axis=1)]
        while len(self.low[-1]) > 1:
            for tree, pick, fill in ((self.low, np.minimum, _NONE), (self.high, np.maximum, -_NONE)):
                level = tree[-1]
                if len(level) % 2:
                    level = tree[-1] = np.append(level, fill)
                tree.append(pick(level[::2], level[1::2]))

    def _inside(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position in a block, beyond an offset, with the excess; -1 if there is none."""
        out = np.full(len(block), -1, np.int64)
        columns = np.arange(_BLOCK)
        for k in range(0, len(block), 1 << 15):
            part = slice(k, k + (1 << 15))
            hit = (self.blocks[block[part]] == target[part, None]) & (columns > after[part, None])
            first = hit.argmax(axis=1)
            found = hit[np.arange(len(first)), first]
            out[part][found] = block[part][found] * _BLOCK + first[found]
        return out

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First block behind the given one whose excess range holds the target (it exists)."""
        node, level = block.copy(), np.zeros(len(block), np.int64)
        climbing = np.ones(len(block), bool)
        for k in range(len(self.low)):  # up, until the right sibling holds it
            low, high = self.low[k], self.high[k]
            right = np.minimum(node + 1, len(low) - 1)
            there = climbing & (node % 2 == 0) & (right > node) & (low[right] <= target) & (target <= high[right])
            node[there], level[there] = right[there], k
            climbing &= ~there
            node[climbing] //= 2
        for k in range(len(self.low) - 1, 0, -1):  # and down again
            at = level == k
            left = node[at] * 2
            node[at] = np.where((self.low[k - 1][left] <= target[at]) & (target[at] <= self.high[k - 1][left]), left, left + 1)
            level[at] = k - 1
        return node

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        target = self.excess[opens] - 1
        block = opens // _BLOCK
        found = self._inside(block, opens % _BLOCK, target)
        left = np.flatnonzero(found < 0)
        if len(left):
            later = self._next_block(block[left], target[left])
            found[left] = self._inside(later, np.full(len(left), -1), target[left])
        return found


class _LeastOf:
    """Least value of ranges of an array, from doubling windows."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (1 << (len(self.levels) - 1)) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), _NONE, np.int64)
        size = end - start
        for k, level in enumerate(self.levels):
            at = (size >> k) == 1
            out[at] = np.minimum(level[start[at]], level[end[at] - (1 << k)])
        return out


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


class Trie:
    """The trie of sorted paths: nodes in preorder, the root first.

    ``keys``: two words for each turn, path after path; ``lengths``: turns of each path; ``words``: of each turn.
    """

    def __init__(self, keys: np.ndarray, lengths: np.ndarray, words: np.ndarray):
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        both = np.minimum(lengths[:-1], lengths[1:])
        same = (keys[ragged(self.starts[:-1], both)] == keys[ragged(self.starts[1:], both)]).all(axis=1)
        self.shared = np.zeros(len(lengths), np.int64)
        if len(same):
            owner = np.repeat(np.arange(len(both)), both)
            place = ragged(np.zeros(len(both), np.int64), both)
            first = both.copy()
            np.minimum.at(first, owner[~same], place[~same])
            self.shared[1:] = first
        elif len(lengths) > 1:
            self.shared[1:] = 0
        fresh = lengths - self.shared
        self.first_new = 1 + np.cumsum(fresh) - fresh
        n = int(1 + fresh.sum())
        self.size = n
        turn = ragged(self.starts + self.shared, fresh)
        self.depth = np.concatenate(([0], ragged(self.shared + 1, fresh)))
        self.words = np.concatenate(([0], words[turn]))
        closes = np.concatenate(([0], lengths[:-1] - self.shared[1:], [lengths[-1] + 1]))
        opens = np.concatenate((fresh, [0]))
        opens[0] += 1
        runs = np.stack((closes, opens), axis=1).ravel()
        self.parens = Parentheses(np.repeat(np.tile(np.array([0, 1], np.int8), len(closes)), runs))
        bits = self.parens.bits
        at = np.flatnonzero(bits)
        close = self.parens.findclose(at)
        rank = np.cumsum(bits)  # opens up to a position
        self.end = rank[close].astype(np.int64)  # preorder number behind the subtree
        self.pair = bits[at + 1] == 0  # a leaf pair
        order = np.lexsort((np.arange(n), self.depth))
        line = self.depth[order] * n + order
        above = np.searchsorted(line, (self.depth - 1) * n + np.arange(n)) - 1
        self.parent = np.where(self.depth > 0, order[np.maximum(above, 0)], -1)

    def path_nodes(self) -> Iterator[np.ndarray]:
        """The nodes of each path, from the root."""
        stack = np.zeros(int(self.lengths.max(initial=0)) + 1, np.int64)
        for shared, length, new in zip(self.shared.tolist(), self.lengths.tolist(), self.first_new.tolist(), strict=True):
            stack[shared + 1 : length + 1] = np.arange(new, new + length - shared)
            yield stack[: length + 1].copy()

    def end_nodes(self) -> np.ndarray:
        """The node at which each path ends."""
        last = np.where(self.lengths > self.shared, self.first_new + self.lengths - self.shared - 1, 0)
        known = np.flatnonzero((self.lengths > self.shared) | (self.lengths == 0))
        return last[known[np.searchsorted(known, np.arange(len(last)), side="right") - 1]] if len(known) else last


def _prefix_keys(path: bytes) -> list[bytes]:
    """A digest of each prefix of a path, the empty one first."""
    state = hashlib.md5(usedforsecurity=False)
    found = [state.digest()]
    for k in range(0, len(path), 16):
        state.update(path[k : k + 16])
        found.append(state.digest())
    return found


_ROWS = (
    "kind string, shard long, depth long, conv_id long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, path binary, words array<long>, keys array<binary>, ids string, "
    + ", ".join(f"{v} array<long>" for v in _VALUES)
)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in _ROWS.split(", "))])


def _rows(n: int, **columns) -> pa.RecordBatch:
    schema = _arrow_schema()
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of the digests of all paths, and the number of turns of each."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.int64).reshape(-1, 2), np.array([len(x) // 16 for x in data], np.int64)


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64)


def _shard(number: int, rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
    """Final nodes, spines and ids of one shard. ``rows``: (path, words, conv_id) or spines of the round before."""
    keys, lengths = _binaries(rows.column("path"))
    trie = Trie(keys, lengths, _flat(rows.column("words").combine_chunks()))
    n, first_round = trie.size, "conv_id" in rows.column_names
    held = {v: np.full(n, _NONE if v == "least" else 0, np.int64) for v in _VALUES}
    if first_round:
        convs, at = rows.column("conv_id").to_numpy(), trie.end_nodes()
        np.add.at(held["ends"], at, 1)
        np.minimum.at(held["least"], at, convs)
    else:
        at = np.concatenate(list(trie.path_nodes()))
        for v in _VALUES:
            (np.minimum if v == "least" else np.add).at(held[v], at, _flat(rows.column(v).combine_chunks()))
    nodes, end = np.arange(n), trie.end
    ends, least = _sums(held["ends"]), _LeastOf(held["least"])
    members, conv = ends[end] - ends[nodes], least(nodes, end)
    spine = np.zeros(n, bool)
    left = np.arange(lengths[0] + 1)
    right = np.flatnonzero(end == n)  # the last path: subtrees that reach the end
    if not last:
        spine[left] = spine[right] = True
    children = held["children"] + np.bincount(trie.parent[1:], minlength=n)
    own = np.where(spine, 0, (members - 1) * trie.words)
    saved = _sums(held["saved"] + own)
    leaves = _sums(held["leaves"] + (trie.pair & (held["children"] == 0) & ~spine))
    done = np.flatnonzero(~spine)
    parent = trie.parent[done]
    known = (parent >= 0) & ~spine[np.maximum(parent, 0)]
    prefix = {}
    if not (last and first_round):
        every = list(trie.path_nodes()) if not first_round else [left, right]
        paths = rows.column("path")
        chosen = range(rows.num_rows) if not first_round else [0, rows.num_rows - 1]
        for row, path in zip(chosen, every, strict=True):
            prefix |= dict(zip(path.tolist(), _prefix_keys(paths[row].as_py()), strict=True))
    sha = None
    if first_round:
        edges = np.flatnonzero(np.diff(at, prepend=-1))
        texts = {int(at[a]): ",".join(map(str, convs[a:b].tolist())) for a, b in zip(edges, np.append(edges[1:], len(at)), strict=True)}
        sha = [hashlib.sha256(texts[v].encode()).hexdigest() if v in texts else _EMPTY for v in done.tolist()]
        if pieces := [(v, t) for v, t in texts.items() if spine[v]]:
            starts = held["least"][[v for v, _ in pieces]]
            yield _rows(len(pieces), kind=["ids"] * len(pieces), conv_id=starts, key=[prefix[v] for v, _ in pieces], ids=[t for _, t in pieces])
    count = len(done)
    yield _rows(
        count,
        kind=["node"] * count,
        shard=np.full(count, number),
        depth=trie.depth[done],
        conv_id=conv[done],
        parent_conv_id=pa.array(conv[np.maximum(parent, 0)], mask=~known),
        parent_key=[None if k or p < 0 else prefix[p] for k, p in zip(known.tolist(), parent.tolist(), strict=True)],
        key=[prefix.get(v) for v in done.tolist()],
        n_convs=members[done],
        n_children=children[done],
        n_leaves=leaves[end[done]] - leaves[done],
        saved_tokens=saved[end[done]] - saved[done],
        **({"ends_sha256": sha} if sha is not None else {}),
    )
    if last:
        return
    # What hangs on each spine node outside the spines: the node itself and the nodes from `low` to `high`.
    low, high = nodes + 1, end.copy()
    low[left[:-1]] = end[left[1:]]
    high[right[:-1]] = right[1:]
    high = np.maximum(low, high)
    hanging = {
        "ends": held["ends"] + ends[high] - ends[low],
        "least": np.minimum(held["least"], least(low, high)),
        "children": children - np.bincount(trie.parent[np.flatnonzero(spine)[1:]], minlength=n),
        "leaves": held["leaves"] + leaves[high] - leaves[low],
        "saved": held["saved"] + saved[high] - saved[low],
    }
    spines = [(0, left, 0)]
    if len(right) > len(left) or (right != left[: len(right)]).any():
        common = min(len(left), len(right))
        differ = np.flatnonzero(left[:common] != right[:common])
        spines.append((rows.num_rows - 1, right, int(differ[0]) if len(differ) else common))
    for row, path, new in spines:
        values = {v: np.where(np.arange(len(path)) < new, _NONE if v == "least" else 0, hanging[v][path]) for v in _VALUES}
        yield _rows(
            1,
            kind=["spine"],
            shard=[number],
            path=[rows.column("path")[row].as_py()],
            words=[trie.words[path[1:]]],
            keys=[[prefix[v] for v in path.tolist()]],
            **{v: [values[v]] for v in _VALUES},
        )


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): every conversation with the first turns of its family's first one."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", key.alias("key"), words.alias("words")).alias("turn")
    )
    own = save(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = own.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, HEADS - 1).alias("_heads"))
    whole = own.withColumn("_h", h.cast("int")).join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_first"), "left")
    before = F.slice(F.coalesce("_heads", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("_h"))
    after = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    whole = whole.select("conv_id", F.concat(before, after).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.words").alias("words"))


def _rounds(paths: DataFrame, shard_turns: int) -> Iterator[DataFrame]:
    """Rows of each round, as written."""
    fields = ["path", "words", *(["conv_id"] if "conv_id" in paths.columns else _VALUES)]
    weight = F.greatest(F.size("words"), F.lit(1)).cast("long")
    total, rows = paths.agg(F.sum(weight), F.count(F.lit(1))).first()
    if not rows:
        return
    last = total <= shard_turns or rows <= LEAST_PATHS
    if last:
        ready = paths.select(*fields).coalesce(1).sortWithinPartitions(*[c for c in ("path", "conv_id") if c in fields])

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := [b for b in batches if b.num_rows]:
                yield from _shard(0, pa.Table.from_batches(held), True)

        yield save(ready.mapInArrow(whole, _ROWS), "trie")
        return
    if "conv_id" in fields:

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, turns = TaskContext.get().partitionId() << 32, [], 0
            for batch in batches:
                sizes = np.maximum(np.diff(np.asarray(batch.column("words").offsets)), 1)
                start = 0
                for stop in range(1, batch.num_rows + 1):
                    turns += int(sizes[stop - 1])
                    if turns >= shard_turns and sum(b.num_rows for b in held) + stop - start >= LEAST_PATHS:
                        yield from _shard(number, pa.Table.from_batches([*held, batch.slice(start, stop - start)]), False)
                        number, held, turns, start = number + 1, [], 0, stop
                if start < batch.num_rows:
                    held.append(batch.slice(start))
            if held:
                yield from _shard(number, pa.Table.from_batches(held), False)
            give_back()

        dealt = paths.select(*fields).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        done = save(dealt.mapInArrow(cut, _ROWS), "trie")
    else:
        size = max(shard_turns, LEAST_PATHS * -(-total // rows))
        placed = paths.select(*fields).withColumn("_turn", F.struct("path", F.monotonically_increasing_id().alias("n"))).withColumn("_size", weight)
        placed = running_totals(save(placed, "spines"), [], "_turn", {"_size": "_upto"}, descending=False)
        placed = placed.withColumn("shard", F.floor((F.col("_upto") - F.col("_size")) / size).cast("long"))

        def one(group: pa.Table) -> pa.Table:
            number = group.column("shard")[0].as_py()
            group = group.combine_chunks().sort_by([("path", "ascending")])
            return pa.Table.from_batches(list(_shard(number, group.select(fields), False)))

        done = save(placed.select("shard", *fields).groupBy("shard").applyInArrow(one, _ROWS), "trie")
    yield done
    yield from _rounds(done.filter("kind = 'spine'").select("path", "words", *_VALUES), shard_turns)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(key, sha): the texts of ids of each key, hashed in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if state:
                        found.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])

    ready = pieces.select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id")
    return ready.mapInArrow(run, "key binary, sha string")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rounds = list(_rounds(save(rebuilt(turns), "paths"), shard_turns))
    if not rounds:
        return turns.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns))
    first = rounds[0]
    nodes = first.filter("kind = 'node'").withColumn("round", F.lit(0))
    if len(rounds) == 1:
        return nodes.select(*columns)
    sha = _hashed(first.filter("kind = 'ids'"))
    merged = [r.filter("kind = 'node'").withColumn("round", F.lit(k)) for k, r in enumerate(rounds[1:], 1)]
    spines = [r.filter("kind = 'spine'").select(F.lit(k).alias("round"), "shard", F.explode("keys").alias("key")) for k, r in enumerate(rounds[:-1])]
    later, above = merged[0], spines[0]
    for m in merged[1:]:
        later = later.union(m)
    for s in spines[1:]:
        above = above.union(s)
    later = save(later.drop("ends_sha256").join(sha, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_EMPTY))).drop("sha"), "merged")
    known = above.distinct().join(later.select("key", F.col("conv_id").alias("above")), "key")
    known = known.withColumnsRenamed({"round": "_round", "shard": "_shard", "key": "_key"})
    both = nodes.select("round", "shard", "parent_key", *columns).union(later.select("round", "shard", "parent_key", *columns))
    on = (F.col("round") == F.col("_round")) & (F.col("shard") == F.col("_shard")) & (F.col("parent_key") == F.col("_key"))
    named = both.filter("parent_key IS NOT NULL").join(known, on, "left").withColumn("parent_conv_id", F.col("above"))
    return named.select(*columns).union(both.filter("parent_key IS NULL").select(*columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
