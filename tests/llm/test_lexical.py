import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import lexical
from termweave.llm.lexical import Lists, build_index, norms, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    words = [(i, terms(x)) for i, x in docs]
    words = [(i, w) for i, w in words if w]
    n, total, df = len(words), sum(len(w) for _, w in words), {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    found = []
    for item, text in items:
        scored = []
        for i, w in words:
            score, m = 0, 10 + 90 * len(w) * n // total
            for t in set(terms(text)) & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    known = [f"{a}{b}" for a in ("Ab", "é", "日", "x9", "QU", "ß") for b in ("", "a", "ı", "7", "nn")]
    weights = [1 / (k + 1) for k in range(len(known))]

    def text(n):
        return "".join(w + rng.choice([" ", "-", "\n", "\x00", ", "]) for w in rng.choices(known, weights, k=n))

    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(250)]
    docs += [(None, text(40)), (None, None), (700, None), (701, ""), (702, " .,"), docs[5], docs[5], *[(900 + k, "QUa é") for k in range(30)]]
    items = [(i, text(rng.choice([1, 2, 7, 40]))) for i in range(30)] + [(50, None), (51, "nowhere"), (None, "QUa é"), (3, "Ab"), (3, "Ab")]
    return docs, items


@pytest.mark.parametrize(("shard_bytes", "item_block"), [(1 << 23, 256), (600, 4)])
def test_ranks_equal_brute_force(spark, tables, shard_bytes, item_block):
    docs, items = tables
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("shard", "term", "ids", "n")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "name", "part", "score")})
    found = search(build_index(df, shard_bytes=shard_bytes), asked, item_block=item_block)
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items)


def test_terms_and_shards():
    rows, words = terms_of(pa.array(["Ab-É x\x7fY", None, "", "a1_b"]))
    assert words.to_pylist() == ["ab", "É", "x", "y", "a1", "b"] and rows.tolist() == [0, 0, 0, 0, 3, 3]
    assert norms(lengths := __import__("numpy").array([10**9, 5]), 10**12, 10**14).tolist() == [10 + 90 * int(n) * 10**12 // 10**14 for n in lengths]


def test_pair_bounds_hold_and_skip_more_than_independent_maxima():
    import numpy as np

    rng = np.random.default_rng(4)
    docs, impacts = [], []
    for k in range(12):
        own = np.flatnonzero(rng.random(4000) < 0.5 / (k + 1))
        docs.append(own)
        impacts.append((rng.pareto(3, len(own)) * 1000 * (k + 1)).astype(np.int64) + 1)
    # never both: the joint maximum is below the sum of the two
    lists = Lists(docs, impacts, {0: list(range(12))}, 4000)
    lists.intersect()
    dense = np.zeros((12, 4000), np.int64)
    for k in range(12):
        dense[k, docs[k]] = impacts[k]
    for bound, unit in lists.units(0):
        assert dense[list(unit)].sum(axis=0).max() == bound <= sum(lists.most[t] for t in unit)
    total = dense.sum(axis=0)
    threshold = int(np.sort(total)[-10])
    seen: dict = {}
    found, scores = lists.search(0, threshold, 10, seen)
    assert sorted(found.tolist()) == np.flatnonzero(total >= threshold).tolist() and (scores == total[found]).all()
    single = np.cumsum([0, *sorted(lists.most)])
    alone = int(np.searchsorted(single, threshold)) - 1
    skipped = 12 - sum(len(u) for _, u in lists.units(0)[int(np.searchsorted(np.cumsum([0] + [b for b, _ in lists.units(0)]), threshold)) - 1 :])
    assert seen["summed"] < seen["all"] and skipped >= alone
    assert (lists.seeds(0, 10) <= np.sort(total)[::-1][: len(lists.seeds(0, 10))]).all()


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    index = build_index(spark.createDataFrame([], docs))
    assert search(index, spark.createDataFrame([(1, "a")], items)).count() == 0
    index = build_index(spark.createDataFrame([(1, "a b"), (2, None)], docs))
    assert search(index, spark.createDataFrame([], items)).count() == 0
    assert [tuple(r)[1:4] for r in search(index, spark.createDataFrame([(1, "a")], items)).collect()] == [(1, 1, 1)]


def test_one_long_text(spark):
    docs = [(1, "word " * 400_000 + "rare"), (2, "rare word")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), shard_bytes=1000)
    found = search(index, spark.createDataFrame([(1, "rare")], "item_id long, text string")).collect()
    assert [(r["rank"], r.doc_id) for r in found] == [(1, 2), (2, 1)] and lexical.collection(index) == (2, 400_003)
