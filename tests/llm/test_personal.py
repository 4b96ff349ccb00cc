import hashlib
import re

from pyspark.sql import functions as F

from termweave.llm import personal as P
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


HARD = [
    "a@b.c-d.e_f@g.h x@y..z q@r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+49 (30) 123.456-78 +1 +12 +123456789012345678", "é😀 mail@example.org 😀 +1 (555) 555-0100", "9" * 30_000, "a" * 60_000 + "@b.c",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "x@y@z.com", "", "a.b@c", "0.0.0.0@1.1.1.1", "1.1.1.1.1.1.1.1",
]


def test_base_spans_equal_plain_matching(docs):
    rows = P.find_personal(docs(list(enumerate(HARD)))).collect()
    for r in rows:
        assert [tuple(s) for s in r.spans if s.kind in P.BASE_KINDS] == base(HARD[r.doc_id]), HARD[r.doc_id][:60]


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in P.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_no_python_in_the_plan(spark, docs):
    plan = P.find_personal(docs(list(enumerate(HARD))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_expectation_maximisation_finds_the_reliable_labelers():
    good, bad = (1, 1, 1, 1, 1), (-1, -1, -1, -1, -1)
    noisy = (1, 1, 1, -1, 1)  # the fourth labeler contradicts the others half of the time
    counts = [("number", good, (1, 1), 500), ("number", noisy, (1, 1), 500), ("number", bad, (2, 0), 400), ("number", (-1, -1, -1, 1, -1), (2, 0), 400)]
    weights = P.estimate(counts)
    assert abs(weights["reliability"]["before:1"]) < 0.2 < weights["reliability"]["check:1"]
    assert weights["length"][1] > 0 > weights["length"][2]


def test_classifier_adds_spans_that_do_not_overlap(docs):
    rows = [(i, f"Please call 030-1234-{1000 + i} or mail me{i}@example.org today.") for i in range(60)]
    rows += [(100 + i, f"Order no 2019-1234-{1000 + i} and part x{i}.") for i in range(60)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in P.find_personal(docs(rows)).collect()}
    assert all(len([s for s in found[i] if s[0] == "email"]) == 1 for i in range(60))
    assert sum(any(s[0] == "number" for s in found[i]) for i in range(60)) >= 55
    assert sum(any(s[0] == "number" for s in found[100 + i]) for i in range(60)) <= 5


def test_redact_and_edges(docs):
    df = docs([(1, "mail a@b.cd now"), (2, None), (3, ""), (1, "mail a@b.cd now"), (None, "é +1 (555) 555-0100.")])
    out = P.redact(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.filter(F.col("text").isNotNull()).collect()) == [
        (0, "é [PHONE]."), (1, "mail [EMAIL] now"), (1, "mail [EMAIL] now"), (3, ""),
    ]
    assert out.filter("text IS NULL").count() == 1
    assert P.redact(df.limit(0)).count() == 0


def test_overlapping_spans_are_masked_whole(docs):
    rows = [
        (1, "to +4915112345678@sms.example.org now"), (2, "to 10.20.30.40@mail.example.org now"), (3, "to 4111111111111111@pay.example.org now"),
        (4, "to x@10.20.30.40 and +1 (555) 555-0100."),
    ]
    assert {r.doc_id: r.text for r in P.redact(docs(rows)).collect()} == {
        1: "to [EMAIL] now", 2: "to [EMAIL] now", 3: "to [EMAIL] now", 4: "to [EMAIL] and [PHONE].",
    }


def test_redact_keeps_columns_with_the_names_it_uses(docs):
    clash = {c: F.lit(c) for c in ("_text", "_card", "_base", "candidates", "_spans", "row", "spans", "text2")}
    df = docs([(1, "mail a@b.cd now"), (2, None)]).withColumns(clash)
    out = P.redact(df)
    assert out.dtypes == df.dtypes
    assert {r.doc_id: (r.text, *(r[c] for c in clash)) for r in out.collect()} == {1: ("mail [EMAIL] now", *clash), 2: (None, *clash)}
