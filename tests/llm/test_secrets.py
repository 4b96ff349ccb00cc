import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import secrets as S
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def base(text):
    found = []
    keyword = r"(password|passwd|secret|token|api_?key)"
    for m in re.finditer(rf"(?ai:{keyword[1:-1]})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 6:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], S.KINDS.index(s[0])))


def entropy(text, window, least):
    spots = [
        i for i in range(len(text) - window + 1)
        if -sum(c / window * math.log2(c / window) for c in Counter(text[i : i + window]).values()) >= least - 1e-9
    ]
    return (spots[0], spots[-1] + window) if spots else None


PIECES = ["password", "token", " = ", ":", '"', "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f60718293a4b5", "é", "😀", " ", "\n", "Zx9Qw8"]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=4))
def test_base_spans_equal_plain_matching(texts):
    found = S.scan_texts(pa.array(texts, pa.string()))
    assert [[s for s in x if s[0] in S.BASE_KINDS] for x in found] == [base(t) for t in texts]


def test_incremental_entropy_equals_direct():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abcdef0123456789XYZ"[: rng.randint(2, 19)]) for _ in range(rng.randint(1, 60)))
        assert S.high_entropy(text.encode(), 20, 3.0) == entropy(text, 20, 3.0)


def test_entropy_finds_keys_and_spares_allowed():
    key = "h7Gk29sLqPz4Xw8VbNm3Tr6Y"
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    rows = S.scan_texts(pa.array([f"key {key} end", f"id {uuid} end", "internationalisierungsprozesse", "1234567890" * 4]))
    assert ("entropy_base64", 4, 28) in rows[0]
    assert rows[1] == [] and rows[2] == []
    assert [s[0] for s in rows[3]] == ["hex"]


def test_edge_rows(docs):
    texts = [(1, None), (2, ""), (3, "token = abcdef"), (3, "token = abcdef"), (None, "AKIA" + "A" * 16), (5, "x" * 200_000 + " token=abcdef1")]
    rows = S.find_secrets(docs(texts)).collect()
    assert len(rows) == 6
    spans = sorted((r[0] or 0, [tuple(s) for s in r[1]]) for r in rows)
    assert spans[0] == (0, [("access", 0, 20)]) and spans[1] == (1, []) and spans[2] == (2, [])
    assert spans[3] == spans[4] == (3, [("assign", 0, 14)])
    assert spans[5][1][-1] == ("assign", 200_001, 200_014)
    assert S.find_secrets(docs(texts).limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_secret_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in S.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_keys_beside_allowed_words_are_found():
    key = "h7Gk29sLqPz4Xw8VbNm3Tr6Y"
    rows = [f"example_db={key}", f"config/sample/{key}", f"{key}/{key}/dummy/{key}", f"123e4567-e89b-12d3-a456-426614174000/{key}"]
    for text, found in zip(rows, S.scan_texts(pa.array(rows)), strict=True):
        covered = {i for k, a, b in found if k == "entropy_base64" for i in range(a, b)}
        assert all(set(range(m.start(), m.end())) <= covered for m in re.finditer(key, text)), text
        assert not any(set(range(m.start(), m.end())) & covered for m in re.finditer("example|sample|dummy|123e4567", text)), text
    assert S.scan_texts(pa.array(["my-example-key-1", "xxxxxxxxxxxxxxxxxxxxxxxxAb1"])) == [[], []]


def test_planted_keys_are_found_whole_and_prose_is_left_alone(spark):
    rng = random.Random(11)
    alphabets = {"lower": "0123456789abcdef", "upper": "0123456789ABCDEF", "wide": "+/" + "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))}
    for name, letters in alphabets.items():
        for before, after in (("", ""), ("api_id=", ""), ("API_ID=", ""), ("key_", ""), ("config/", ""), ("id: ", " end"), ("k=", "==")):
            keys = ["".join(rng.choices(letters, k=32)) for _ in range(400)]
            rows = S.scan_texts(pa.array([f"see {before}{k}{after}" for k in keys]))
            at = 4 + len(before)
            whole = sum(any(k.startswith("entropy") and a <= at and b >= at + 32 for k, a, b in found) for found in rows)
            # a key whose windows all fall short of the limit is the method's miss
            least = 0.95
            assert whole >= least * len(keys), (name, before, whole)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").collect()]
    added = [(t, s) for t, x in zip(texts, S.scan_texts(pa.array(texts)), strict=True) for s in x if s[0] not in S.BASE_KINDS]
    words = sum(len(t.split()) for t in texts)
    assert all(any(c.isdigit() for c in t[a:b]) or not t[a:b].islower() for t, (_, a, b) in added)
    assert len(added) < words / 1000
    prose = ["https://example.org/wiki/The_Quick_Brown_Fox/Jumps-over-the-lazy-dog", "CamelCaseIdentifiersAreNoSecrets snake_case_identifiers_2024_01"]
    assert S.scan_texts(pa.array(prose)) == [[], []]


def test_a_span_stops_at_plain_words():
    key = "h7Gk29sLqPz4Xw8VbNm3Tr6Y"
    (found,) = S.scan_texts(pa.array([f"/static/assets/{key}/index/page"]))
    assert [f"/static/assets/{key}/index/page"[a:b] for _, a, b in found][0].strip("/").startswith(("assets", key))
