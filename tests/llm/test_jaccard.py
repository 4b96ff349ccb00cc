import inspect
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from termweave.llm import jaccard as J
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """(links, component) by position, all pairs that share a shingle."""
    known = [sets(t) for _, t in rows]
    holders = defaultdict(list)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(known):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, c in common.items():
            if rows[i][0] is not None and rows[j][0] is not None and c >= threshold * (len(s) + len(known[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least or d is not None and d < least[r] else least[r]
    return sorted((none(d), links[i], none(least[find(i)])) for i, (d, _) in enumerate(rows))


def none(x):
    """A missing id as a number."""
    return -1 if x is None else x


def result(df):
    return sorted((none(r.id), r.n_links, none(r.component)) for r in df.collect())


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small,chunk", [(64, 1024), (4, 5)])
def test_planted_copies(docs, prose, monkeypatch, small, chunk):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "CHUNK", chunk)
    rng = random.Random(6)
    texts = [prose(i, 150) for i in range(30)]
    rows = list(enumerate(texts)) + [(100 + i, texts[i % 6]) for i in range(20)]
    rows += [(200 + i, edited(texts[i % 3], rng, rng.randint(1, 8))) for i in range(40)]
    rows += [(300, None), (301, ""), (302, "a b"), (303, "a b"), (304, " a\tb "), (305, prose(99, 20_000)), (306, prose(99, 20_000) + " end")]
    rows += [(None, texts[0]), (7, texts[7])]
    rng.shuffle(rows)
    assert result(J.similarity_join(docs(rows), recall=0.9999)) == brute(rows)


def test_empty(docs):
    assert J.similarity_join(docs([(1, "a")]).limit(0)).count() == 0
    assert result(J.similarity_join(docs([(1, None)]))) == [(1, 0, 1)]


def test_shingles_are_sets_of_five_words():
    texts = ["a b c d e f", "a  b\nc\td e f", "a b c d e a b c d e", "a b", "", None, "a b c d e"]
    values, ends = J.shingles(pa.array(texts))
    own = [frozenset(values[ends[i] : ends[i + 1]].tolist()) for i in range(len(texts))]
    assert own[0] == own[1] and [len(s) for s in own] == [2, 2, 5, 1, 0, 0, 1] and own[6] < own[0]


def test_runs_reach_the_recall():
    assert J.runs_needed(0.8, 0.99, depth=1) == 5
    assert J.runs_needed(0.8, 0.99) >= J.runs_needed(0.8, 0.99, depth=1)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in QUERIES["op8_ngram_jaccard_join"](spark, SF).collect())
    want = brute(rows)
    assert got == want


def test_defaults_reach_the_recall(docs, prose):
    """The production defaults, signature filter included, lose at most one pair in 10,000 at the threshold."""
    recall = inspect.signature(J.similarity_join).parameters["recall"].default
    least = J.least_common(0.8, recall)
    assert recall >= 0.9999 and 0 < J.common_tokens(0.8)[:least].sum() < 1e-5
    assert J.runs_needed(0.8, recall, least=least) >= J.runs_needed(0.8, recall)
    rng = random.Random(8)
    texts = [prose(i, 150) for i in range(12)]
    rows = list(enumerate(texts)) + [(100 + i, edited(texts[i % 12], rng, rng.randint(1, 4))) for i in range(60)]
    assert result(J.similarity_join(docs(rows))) == brute(rows)
