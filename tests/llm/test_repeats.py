import hashlib
import random

import numpy as np
import pytest

from termweave.llm import repeats as R
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(n_bytes, n_removed, n_spans, digest) of each row, by a table of all 50-byte strings."""
    least = {}
    late = float("inf")
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            least[raw[k : k + 50]] = min(least.get(raw[k : k + 50], late), late if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < (late if i is None else i):
                gone[k : k + 50] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0
        out.append((-1 if i is None else i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("length", [2, 4, 50])
def test_expansion_equals_comparison(length):
    rng = np.random.default_rng(length)
    for _ in range(40):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(1, 300)).astype(np.int16)
        order, same = R.same_prefix(s, length)
        cut = [tuple(s[i : i + length]) for i in order]
        assert sorted(order.tolist()) == list(range(len(s)))
        for k in range(1, len(s)):
            if len(cut[k]) == len(cut[k - 1]) == length:
                assert same[k] == (cut[k] == cut[k - 1])


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 16, 25):
        assert R.sliding_least(x, width).tolist() == [int(x[i : i + width].min()) for i in range(len(x) - width + 1)]


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_planted_passages(docs, prose, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    rng = random.Random(11)
    shared = [prose(900 + i, 30) for i in range(4)]
    rows = [(i, prose(i, 60) + "".join(rng.choice(shared)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 3))) + "é😀") for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1][7:]), (101, rows[3][1][7:]), (None, rows[5][1]), (102, "a" * 500), (103, "a" * 49), (104, "a" * 70)]
    rows += [(200, None), (201, ""), (202, "x" * 50), (203, "\0" * 60), (204, "\0" * 55), (205, prose(77, 15_000)), (206, prose(77, 15_000)[3000:])]
    assert result(R.remove_repeats(docs(rows))) == brute(rows)


@pytest.mark.parametrize("hot", [-1, 0, 5, 40])
def test_hot_minimizers_go_window_by_window(docs, prose, monkeypatch, hot):
    """A passage in all documents, with edges of their own; small bounds make many or few minimizers hot."""
    monkeypatch.setattr(R, "BLOCK_BYTES", 4000)
    rng = random.Random(5)
    passage = prose(900, 30)
    rows = [(i, prose(i, rng.randint(0, 40)) + passage[rng.randint(0, 9) :] + prose(50 + i, rng.randint(1, 30))) for i in range(60)]
    rows += [(70, passage[:49]), (71, "a" * 200), (72, "b" + "a" * 120), (None, rows[4][1]), (3, rows[3][1]), (73, None)]
    assert result(R.remove_repeats(docs(rows), hot=hot)) == brute(rows)


def test_whole_characters(docs):
    text = "é" * 60
    rows = R.remove_repeats(docs([(1, text), (2, "x" + text + "ß")]), whole_characters=True).collect()
    assert {r.doc_id: r.kept.decode() for r in rows} == {1: text, 2: "xß"}
    assert R.remove_repeats(docs([(1, "a")]).limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_array_dedup"](spark, SF).collect())
    assert got == brute(rows)
