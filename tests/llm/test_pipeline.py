import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from test_jaccard import brute as groups
from test_personal import base
from test_repeats import brute as cuts
from test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before the first stage and after each."""
    found = [C.table(spark, SF, "documents")]
    for name, stage in C.STAGES:
        found.append(C.save(stage(spark, found[-1], SF), name))
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_classifier_keeps_trusted(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
    assert len(good & set(after)) >= 0.98 * len(good) and len(bad & set(after)) <= 0.5 * len(bad)


def test_one_of_each_group_stays(stages):
    before = texts(stages[1])
    assert set(texts(stages[2])) == {d for d, _, c in groups(sorted(before.items())) if d == c}


def test_repeats_are_cut(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    gone = {i: n for i, _, n, _, _ in cuts(sorted(before.items()))}
    for i, t in before.items():
        lost = len(t.encode()) - len(after[i].encode())
        assert gone[i] - 6 * 40 <= lost <= gone[i]
        assert (lost == 0) == (after[i] == t)


def test_personal_data_is_masked(stages):
    before, after = texts(stages[3]), texts(stages[4])
    for i, t in before.items():
        assert not base(after[i])
        assert base(t) or after[i] == t or "[" in after[i]


def test_packing_holds_all_ids(stages):
    check_pieces(stages[5].collect(), texts(stages[4]))


def test_all_stages_on_hard_rows(spark, docs, prose):
    """Null texts and ids, repeated rows, an empty text and columns with the stages' own names."""
    same = prose(1, 60)
    rows = [(i, prose(i, 60)) for i in range(30)] + [(50, same), (50, same), (None, prose(70, 60)), (None, None), (60, None), (61, "")]
    names = ("_gone", "_text", "candidates", "_repeat_kept", "_block", "id", "component")
    df = docs(rows).withColumns({c: F.lit(7) for c in names})
    now = df
    for name, stage in C.STAGES[:4]:
        now = C.save(stage(spark, now, SF), name)
        assert now.dtypes == df.dtypes, name
        assert now.filter(" OR ".join(f"{c} <> 7" for c in names)).count() == 0
    kept = now.collect()
    assert {r.doc_id for r in kept} >= {None, 60} and sum(r.doc_id == 50 for r in kept) in (0, 2)
    pieces = C.STAGES[4][1](spark, now, SF)
    assert pieces.count() >= len(kept)


def test_an_empty_table(spark, docs):
    now = docs([(1, "a")]).limit(0)
    for name, stage in C.STAGES:
        now = C.save(stage(spark, now, SF), name)
        assert now.count() == 0, name
