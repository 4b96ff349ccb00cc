import re
from collections import Counter

from termweave.llm.quality_rules import clean_lines
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = [False] * len(words)
    for i in range(len(words) - 7):
        if wins[tuple(words[i : i + 8])] > 1:
            marked[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 20 or 100 * sum(marked) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(marked), failed


def values(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert values(r) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_lines(docs, prose):
    good = prose(1, 60)
    shout = "BUY THIS NOW AND SAVE MUCH MONEY TODAY FRIENDS\n" * 20
    rows = {
        r.doc_id: r
        for r in clean_lines(
            docs([(1, good), (2, good + "\nHome | About | Contact | Login\nAll rights reserved 2020."), (3, "a b c.\n" + shout), (4, good + "\n" + good)])
        ).collect()
    }
    assert rows[1].kept and rows[1].clean_text == good
    assert rows[2].kept and rows[2].clean_text == good
    assert not rows[3].kept and rows[3].clean_text == "a b c."
    assert rows[4].n_dup_lines == 1 and rows[4].base_failed


def test_edges(docs, prose):
    texts = [None, "", " \t\n\x0b", "é😀 wort\x1c\x85x", "w " * 30, prose(2, 20_000), "# " * 25]
    got = {r.doc_id: r for r in clean_lines(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert values(got[i]) == brute(t), i
    assert not got[0].kept and not got[1].kept
    twice = clean_lines(docs([(None, "a b"), (None, "a b")])).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert clean_lines(docs([(1, "a")]).limit(0)).count() == 0
