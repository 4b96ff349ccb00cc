import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm.prefix_trie import Parentheses, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            conv.setdefault(c, []).append(((t is not None, t or 0, key), (r, x)))
    conv = {c: [y for _, y in sorted(v)] for c, v in conv.items()}
    paths = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(conv.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    nodes, kids = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    own = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in nodes.items()}
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        for d in range(len(p) + 1):
            saved[p[:d]] += own[p]
            leaves[p[:d]] += p not in kids
    found = []
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        above = min(nodes[p[:-1]]) if p else None
        found.append((min(m), len(p), above, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def result(df, turns=200_000):
    return sorted((tuple(r) for r in prefix_trie(df, turns).collect()), key=str)


def test_findclose_matches_a_stack():
    rng = random.Random(3)
    for size in (1, 2, 40, 3000):
        bits, depth, left = [1], 1, size - 1
        while depth or left:
            if left and (depth <= 1 or rng.random() < (0.9 if len(bits) // 400 % 2 else 0.4)):
                bits, depth, left = [*bits, 1], depth + 1, left - 1
            elif depth > 1 or not left:
                bits, depth = [*bits, 0], depth - 1
        stack, close = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                close[stack.pop()] = k
        opens = np.flatnonzero(bits)
        assert Parentheses(np.array(bits, np.int8)).findclose(opens).tolist() == [close[k] for k in opens.tolist()]


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(1)
    rows = []
    for c in [*range(200), -1, -19, -20, -21, 10**18]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x y", "z", None, "", "x"])))
    rows += [(c, t, "u", f"copy {t}") for c in range(1000, 1400) for t in range(3)]  # a hot conversation
    rows += [(500, t, "u", f"same {t % 3}") for t in range(300)]  # a long one
    return [*rows, (None, 1, "u", "x"), *rows[:50]]


@pytest.mark.parametrize("turns", [200_000, 400, 30])
def test_every_number_of_shards_gives_the_nodes_of_brute_force(spark, hard, turns):
    assert result(spark.createDataFrame(hard, TURNS).repartition(5), turns) == brute(hard)


def test_turnless_paths_empty_tables_and_clashing_columns(spark):
    # 1404 and 1407 take three turns of 1400, which is not there, and have at most three of their own
    rows = [(c, t, "u", "w") for c in range(1401, 1410) for t in range(2)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("path", "words", "kind", "depth", "_h", "key")})
    assert result(df) == result(df, 1) == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in result(df))
    empty = spark.createDataFrame([], TURNS)
    assert result(empty) == result(spark.createDataFrame([(None, 1, "u", "x")], TURNS)) == []
    assert prefix_trie(empty).columns == prefix_trie(df).columns
