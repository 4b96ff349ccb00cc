"""Exactness under skew, independence of partitioning, invariants and restart safety."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import dag, labels, order, ranking, similarity
from termweave.streaming.incremental import incremental_finalize


@pytest.fixture(params=[1, 4, 32])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _skewed(spark, n=3000):
    """A third of the rows share one value, another third sits between two close values."""
    rng = np.random.default_rng(7)
    data = [(f"e{i}", 0.0 if i % 3 == 0 else (0.5 + float(rng.random()) * 1e-6 if i % 3 == 1 else float(rng.normal()))) for i in range(n)]
    return data, spark.createDataFrame(data, "entry_id STRING, score DOUBLE")


def test_global_rank_is_exact(spark, partitions):
    data, df = _skewed(spark)
    want = sorted(data, key=lambda r: (r[1], hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    got = {r["entry_id"]: r["rank"] for r in order.global_rank(df, "entry_id", value="score").collect()}
    assert got == {e: i + 1 for i, (e, _) in enumerate(want)}


def test_running_totals_are_exact(spark, partitions):
    data, df = _skewed(spark, 900)
    sums = df.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("hot"))
    got = {r["score"]: r["c"] for r in order.running_totals(sums, ["k"], "score", {"n": "c"}).collect()}
    for value in list(got)[:50]:
        assert got[value] == sum(1 for _, s in data if s >= value)


def test_split_is_exact_disjoint_and_stable(spark, partitions):
    df = spark.range(1003).select(F.concat(F.lit(" p"), F.col("id").cast("string")).alias("entry_id"))
    got = ranking.split(df.union(df), {"train": 0.8, "val": 0.1, "test": 0.1}, 3)
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) == 1003 and len({e for e, _ in rows}) == 1003
    counts = {s: sum(1 for _, x in rows if x == s) for s in ("train", "val", "test")}
    assert counts == {"train": 803, "val": 100, "test": 100}
    # the same rows whatever the number of partitions: the order is that of the hashes
    ordered = sorted((hashlib.md5(f"{e}|3".encode()).hexdigest(), e) for e, _ in rows)
    assert {e for _, e in ordered[: counts["train"]]} == {e for e, s in rows if s == "train"}


def test_stratified_sample_is_exact_with_a_hot_stratum(spark, partitions):
    data = [(i, "C" if i % 10 < 7 else ("CF" if i % 10 < 9 else "P")) for i in range(1234)]
    df = spark.createDataFrame(data, "entry_id INT, stratum STRING")
    got = ranking.stratified_sample(df, 0.15, 1)
    assert got.count() == round(1234 * 0.15) and got.select("entry_id").distinct().count() == round(1234 * 0.15)


def test_bucket_sample_short_group_draws_again(spark):
    bucket = spark.createDataFrame([(f"e{i}",) for i in range(4)], "entry_id STRING")
    liked = spark.createDataFrame([("e1",), ("zz",)], "entry_id STRING")
    got = ranking.bucket_sample(bucket, 10, liked, seed=2).orderBy("draw_no").collect()
    assert [r["draw_no"] for r in got] == list(range(1, 11)) and got[0]["entry_id"] == "e1"
    assert all(r["entry_id"] != "e1" for r in got[1:])
    assert ranking.bucket_sample(bucket, 3, seed=2).select("entry_id").distinct().count() == 3


def _brute_pairs(sets, cut):
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and len(x & y) / len(x | y) >= cut:
            out.add((a, b))
    return out


def _expand(rows):
    """All pairs told by a graph in which copies hang on their representative."""
    ids = {r["a"] for r in rows}
    links = {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]}
    return ids, links


@pytest.mark.parametrize("cut", [0.2, 0.5, 0.8, 1.0])
def test_pair_graph_matches_brute_force(spark, cut):
    rng = np.random.default_rng(11)
    sets, seen = {}, set()
    while len(sets) < 80:
        s = frozenset(int(v) for v in rng.integers(0, 14, size=rng.integers(1, 8)))
        if s not in seen:
            seen.add(s)
            sets[len(sets)] = s
    df = spark.createDataFrame([(e, t) for e, s in sets.items() for t in s], "entry_id INT, token INT")
    rows = similarity.pair_graph(df, cut).collect()
    ids, links = _expand(rows)
    assert ids == set(sets)
    assert {(a, b) for a, b in links if a < b} == _brute_pairs(sets, cut)
    assert all((b, a) in links for a, b in links)
    assert sum(r["a"] == r["b"] for r in rows) == 80


def test_copies_are_complete_but_cost_one_row_each(spark):
    same = [(i, t) for i in range(30) for t in (1, 2, 3)]
    near = [(1000, t) for t in (1, 2, 3, 4)]
    df = spark.createDataFrame(same + near, "entry_id INT, token INT")
    edges, members = similarity.representatives(df, 0.5)
    assert [tuple(r) for r in edges.collect()] == [(0, 1000, 0.75)] and members.count() == 31
    rows = {(r["a"], r["b"]): r["weight"] for r in similarity.pair_graph(df, 0.5).collect()}
    want = {(a, b): 1.0 for a in range(30) for b in range(30)} | {(1000, 1000): 1.0}
    assert rows == want | {x: 0.75 for a in range(30) for x in ((a, 1000), (1000, a))}
    near = similarity.knn(*similarity.nearest_representatives(df, 3), 3).collect()
    listed = {a: [r["b"] for r in sorted(near, key=lambda r: r["rank"]) if r["a"] == a] for a in (*range(30), 1000)}
    assert listed[0] == [1, 2, 3] and listed[2] == [0, 1, 3] and listed[20] == [0, 1, 2] and listed[1000] == [0, 1, 2]


@pytest.mark.parametrize(("k", "rounds"), [(1, (0.5, 0.2, 0.05)), (4, (0.9,)), (25, ()), (200, (0.3,))])
def test_nearest_neighbours_match_brute_force_without_a_cut(spark, k, rounds):
    rng = np.random.default_rng(5)
    sets = {e: frozenset(int(v) for v in rng.zipf(1.6, size=rng.integers(1, 12)) % 60) for e in range(120)}
    sets |= {200 + e: sets[e % 4] for e in range(20)} | {300: frozenset([1000]), 301: frozenset(range(2000, 2300)), 302: frozenset(range(2000, 2310))}
    df = spark.createDataFrame([(e, t) for e, s in sets.items() for t in s], "entry_id INT, token INT")
    near, members = similarity.nearest_representatives(df, k, rounds)
    got = sorted((r["a"], r["rank"], r["b"], round(r["weight"], 9)) for r in similarity.knn(near, members, k).collect())
    want = []
    for a, s in sets.items():
        others = sorted((-len(s & t) / len(s | t), b) for b, t in sets.items() if b != a and s & t)
        want += [(a, i, b, round(-w, 9)) for i, (w, b) in enumerate(others[:k], 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("width", [3, 64, 65, 1000])
def test_vector_sum_of_any_width(spark, width):
    from termweave.operators import graph

    rows = [("a", [float(i * k) for i in range(width)]) for k in range(5)] + [(None, [1.0] * width), ("a", None)]
    df = spark.createDataFrame(rows, "k STRING, v ARRAY<DOUBLE>")
    got = {r["k"]: r["vec"] for r in graph.vector_sum(df, ["k"], F.col("v")).collect()}
    assert got == {"a": [10.0 * i for i in range(width)], None: [1.0] * width}
    with pytest.raises(Exception, match="elements expected"):
        graph.vector_sum(df, ["k"], F.col("v"), dim=width - 1).collect()
    mixed = df.union(spark.createDataFrame([("a", [1.0])], df.schema))
    with pytest.raises(Exception, match="elements expected"):
        graph.vector_sum(mixed, ["k"], F.col("v")).collect()


def test_closure_is_idempotent_and_scores_are_monotone(spark):
    edges = spark.createDataFrame([(i, i // 3) for i in range(1, 200)] + [(i, i // 5) for i in range(1, 200, 4)], "child INT, parent INT")
    terms = spark.range(200).select(F.col("id").cast("int").alias("term"), F.lit("F").alias("aspect"))
    closure = dag.ancestors(edges, terms)
    again = dag.reach(closure.select(F.col("term").alias("child"), F.col("ancestor").alias("parent")))
    assert closure.count() == again.count()
    scores = spark.range(200).select((F.col("id") % 7).alias("entry_id"), F.col("id").cast("int").alias("term"), (F.pmod(F.hash("id"), F.lit(100)) / 100).alias("score"))
    up = dag.propagate_ontology(scores, closure)
    child = up.join(closure, "term").select("entry_id", F.col("ancestor").alias("term"), F.col("score").alias("below"))
    assert child.join(up, ["entry_id", "term"]).filter("score < below").count() == 0


def test_frequency_score_does_not_depend_on_partitioning(spark, partitions):
    notes = spark.range(500).select((F.col("id") % 20).alias("entry_id"), (F.col("id") % 7).alias("term"))
    freq = labels.term_frequency(notes, by_aspect=False)
    rows = sorted((r["entry_id"], round(r["score"], 9)) for r in labels.frequency_score(notes, freq, notes).collect())
    assert len(rows) == 20 and all(s > 0 for _, s in rows)


def test_incremental_finalize_resumes(spark, tmp_path):
    from termweave.streaming.incremental import read_finished

    schema = "entry_id BIGINT, term BIGINT, score DOUBLE"
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    closure = spark.createDataFrame([(2, 1)], "term BIGINT, ancestor BIGINT")

    def arrives(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental_finalize(spark, src, out, state, closure, schema)
        incremental_finalize(spark, src, out, state, closure, schema)  # nothing new: nothing changes
        return sorted(tuple(r) for r in read_finished(spark, out).select("entry_id", "term", "score_text").collect())

    assert arrives([(1, 2, 0.5), (1, 3, float("nan"))]) == [(1, 1, "0.5"), (1, 2, "0.5")]
    # late rows of entry 1 count together with the earlier ones; entry 7 is new
    both = arrives([(1, 2, 0.25), (1, 1, 0.75), (7, 2, 0.25)])
    assert both == [(1, 1, "0.75"), (1, 2, "0.5"), (7, 1, "0.25"), (7, 2, "0.25")]
    # a batch writes the keys that it holds and nothing of the history
    third = arrives([(9, 5, 0.125)])
    assert third == [*both, (9, 5, "0.125")]
    batches = spark.read.parquet(out).groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in batches} == {0: 2, 1: 4, 2: 1}


def test_a_retried_batch_writes_its_rows_once(spark, tmp_path):
    import shutil

    from termweave.streaming.incremental import read_finished

    schema = "entry_id BIGINT, term BIGINT, score DOUBLE"
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    closure = spark.createDataFrame([(2, 1), (3, 1)], "term BIGINT, ancestor BIGINT")
    for rows in ([(1, 2, 0.5)], [(1, 3, 0.75), (1, 2, 0.125)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental_finalize(spark, src, out, state, closure, schema)
    want = sorted(tuple(r) for r in read_finished(spark, out).collect())
    assert [r[:3] for r in want] == [(1, 1, 0.75), (1, 2, 0.5), (1, 3, 0.75)]
    # the second batch fails after its output, before its commit: it runs again
    (tmp_path / "state" / "commits" / "1").unlink()
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    shutil.rmtree(out + "/batch_id=1")
    incremental_finalize(spark, src, out, state, closure, schema)
    assert sorted(tuple(r) for r in read_finished(spark, out).collect()) == want


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(38,3)", "string"])
def test_global_rank_keeps_null_and_large_values(spark, partitions, kind):
    from decimal import Decimal

    big = {"double": lambda i: [None, float("nan"), -0.0, 0.0, float("-inf"), 1.5][i % 6], "bigint": lambda i: None if i % 7 == 0 else 2**53 + i % 40,
           "decimal(38,3)": lambda i: None if i % 7 == 0 else Decimal(10**20) + Decimal(i % 40) / 1000, "string": lambda i: None if i % 7 == 0 else f"v{i % 5}"}[kind]
    data = [(f"e{i}", None if i % 3 == 0 else "k", big(i)) for i in range(600)]
    df = spark.createDataFrame(data, f"entry_id string, k string, v {kind}")
    got = {r["entry_id"]: (r["rank"], r["n"]) for r in order.global_rank(df, "entry_id", value="v", keys=["k"], total="n").collect()}
    assert len(got) == 600

    def line(r):
        v = r[2]
        place = (0, 0) if v is None else (2, 0) if v != v else (1, v)
        return place, hashlib.md5(r[0].encode()).hexdigest(), r[0]

    for key in (None, "k"):
        rows = sorted((r for r in data if r[1] == key), key=line)
        assert [got[r[0]] for r in rows] == [(i + 1, len(rows)) for i in range(len(rows))]


def test_rank_of_one_value_is_by_hash(spark, partitions):
    df = spark.range(500).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entry_id"), F.lit(None).cast("double").alias("v"))
    got = {r["entry_id"]: r["rank"] for r in order.global_rank(df, "entry_id", value="v").collect()}
    want = sorted(got, key=lambda e: (hashlib.md5(e.encode()).hexdigest(), e))
    assert [got[e] for e in want] == list(range(1, 501))


def test_null_keys_stay_in_totals_and_samples(spark, partitions):
    sums = spark.createDataFrame([(None, 1.0, 2), (None, 3.0, 5), ("a", None, 7), ("a", 2.0, 1)], "k string, v double, n int")
    got = {(r["k"], r["v"]): r["c"] for r in order.running_totals(sums, ["k"], "v", {"n": "c"}).collect()}
    assert got == {(None, 3.0): 5, (None, 1.0): 7, ("a", 2.0): 1, ("a", None): 8}
    rows = spark.createDataFrame([("x", None), ("y", None), ("z", "s")], "entry_id string, stratum string")
    assert ranking.stratified_sample(rows, 1.0).count() == 3
    drawn = ranking.bucket_sample(spark.createDataFrame([(None, "x"), (None, "y"), ("b", "z")], "g string, entry_id string"), 2, keys=["g"])
    assert sorted((r["g"] or "", r["entry_id"]) for r in drawn.collect()) == [("", "x"), ("", "y"), ("b", "z"), ("b", "z")]


def test_nan_is_never_a_prediction(spark):
    from termweave.operators import relational

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("e", 1, nan), ("e", 2, 0.5), ("e", 3, None), ("e", 4, inf), ("e", 5, -inf)], "entry_id string, term int, score double")
    assert sorted((r["term"], r["score"]) for r in relational.noise_floor(df).collect()) == [(2, 0.5), (4, 1.0)]
    assert [r["term"] for r in ranking.top_predictions(df, 2).orderBy("term").collect()] == [2, 4]


def test_missing_score_counts_as_zero(spark):
    from termweave.operators import metrics

    df = spark.createDataFrame([("a", 1, 0.9, 1), ("b", 1, None, 1), ("c", 1, 0.5, 0)], "entry_id string, term int, score double, label int")
    got = metrics.term_ranking(df, 4).collect()[0]
    assert got["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 4)
    assert got["auc"] == pytest.approx((2 + 0.5) / 4)


def _deals(df, *keys):
    """Exchanges of a plan that deal by exactly these columns."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"hashpartitioning\(" + ", ".join(rf"{k}#\d+L?" for k in keys) + r", \d+\)", plan))


def test_propagation_deals_no_row_per_ancestor(spark):
    closure = spark.createDataFrame([(3, 2), (3, 1), (2, 1), (9, 1)], "term BIGINT, ancestor BIGINT")
    scores = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.75), (1, 3, 0.25), (2, 9, float("nan")), (2, 3, None), (None, 2, 0.5)], "entry_id BIGINT, term BIGINT, score DOUBLE")
    up = dag.propagate_scores(scores, closure)
    got = sorted(((r[0] or 0, r[1], repr(r[2])) for r in up.collect()))
    assert got == [(0, 1, "0.5"), (0, 2, "0.5"), (1, 1, "0.75"), (1, 2, "0.75"), (1, 3, "0.5"), (2, 1, "nan"), (2, 2, "None"), (2, 3, "None"), (2, 9, "nan")]
    targets = scores.select("entry_id", "term", F.coalesce((F.col("score") > 0.3).cast("int"), F.lit(0)).alias("label"))
    marked = dag.propagate_targets(targets, closure)
    assert sorted(tuple(r) for r in marked.filter("entry_id = 1").collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 1)]
    for df in (up, marked):
        assert _deals(df, "entry_id", "term") == 0 and _deals(df, "entry_id") == 1
    # the k best of an entry, with ties by term, from the k smallest terms of each score
    ranked = sorted((r for r in up.filter("entry_id = 1").collect()), key=lambda r: (-r["score"], r["term"]))
    for k in (1, 2, 3, 4):
        best = dag.propagate_scores(scores.filter("entry_id = 1"), closure, k).collect()
        assert sorted((r["term"], r["score"]) for r in best) == sorted((r["term"], r["score"]) for r in ranked[:k])


def test_scores_travel_once_through_vocabulary_and_ontology(spark):
    from termweave.plans.pipelines import finalize_predictions

    edges = spark.createDataFrame([(4, 3), (3, 2), (2, 1)], "child BIGINT, parent BIGINT")
    terms = spark.createDataFrame([(1, "C"), (2, "C"), (3, "P"), (4, "P")], "term BIGINT, aspect STRING")
    within = spark.createDataFrame([(3, 2)], "term BIGINT, ancestor BIGINT")  # leads from one aspect to the other
    scores = spark.createDataFrame([(1, 4, 0.5), (1, 3, 0.25)], "entry_id BIGINT, term BIGINT, score DOUBLE")
    done = finalize_predictions(scores, terms, edges, k=10, vocab_closure=within)
    assert sorted((r["term"], r["score"]) for r in done.collect()) == [(1, 0.25), (2, 0.25), (3, 0.5), (4, 0.5)]
    assert _deals(done, "entry_id", "term") + _deals(done, "entry_id") == 2


def test_most_specific_sends_scores_to_scored_ancestors_only(spark):
    below = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (8, 9)], "term BIGINT, descendant BIGINT")
    scores = spark.createDataFrame(
        [(1, 1, 0.5), (1, 3, 0.5), (1, 1, 0.75), (2, 2, 0.0), (2, 3, -1.0), (3, 9, 0.0), (4, 1, 0.1), (4, 7, None)], "entry_id BIGINT, term BIGINT, score DOUBLE"
    )
    left = dag.most_specific(scores, below)
    assert sorted((r[0], r[1], r[2] is not None and r[2]) for r in left.collect()) == [(1, 1, 0.75), (1, 3, 0.5), (2, 3, -1.0), (3, 9, 0.0), (4, 1, 0.1), (4, 7, False)]
    assert _deals(left, "entry_id", "term") == 0 and _deals(left, "entry_id") == 1


def test_stream_state_holds_arrived_terms_only(spark, tmp_path):
    from termweave.streaming.incremental import read_finished

    schema = "entry_id BIGINT, term BIGINT, score DOUBLE"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    closure = spark.createDataFrame([(100, a) for a in range(50)], "term BIGINT, ancestor BIGINT")
    spark.createDataFrame([(1, 100, 0.5), (2, 100, 0.25)], schema).coalesce(1).write.parquet(src)
    ended = incremental_finalize(spark, src, out, str(tmp_path / "state"), closure, schema)
    assert sum(op["numRowsTotal"] for op in ended.recentProgress[0]["stateOperators"]) == 2
    assert read_finished(spark, out).count() == 102


def test_a_hot_token_sends_short_lists(spark):
    # all sets share token 0 alone; sets of two tokens come first, then by id
    sets = [(e, 0) for e in range(300)] + [(e, 1000 + 10 * e + i) for e in range(300) for i in range(1 + e % 3)]
    reps, _ = similarity._groups(spark.createDataFrame(sets, "entry_id INT, token INT"))
    lists = {r["a"]: [x["b"] for x in r["near"]] for r in similarity._by_one_token(similarity._ordered(reps), 3).collect()}
    assert len(lists) == 300 and lists[299] == [0, 3, 6, 9] and lists[3] == [0, 6, 9, 12]


@pytest.mark.parametrize("block", [40, 1 << 22])
def test_homology_graph_counts_shingles_without_dealing_them(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc"), 60)) for _ in range(30)]
    texts += [t[:50] + "".join(rng.choice(list("abc"), 12)) for t in texts[:15]] + texts[:5] + ["", "ab"]
    held = {}
    keep = similarity.written
    monkeypatch.setattr(similarity, "BLOCK_TOKENS", block)
    monkeypatch.setattr(similarity, "written", lambda df, name: held.setdefault(name, keep(df, name)))
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id INT, sequence STRING")
    got = {(r["a"], r["b"]) for r in similarity.homology_graph(df, 6, 0.5).collect()}
    sets = [{t[i : i + 6] for i in range(len(t) - 5)} for t in texts]
    near = lambda x, y: x and y and len(x & y) / len(x | y) >= 0.5
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a == b or near(x, y)}
    assert got == want and len(want) > 60
    # the sets are written as fingerprints; of the tokens only those that several entries hold, in their order
    assert held["sets"].columns == ["entry_id", "size", "_f1", "_f2"]
    assert all(len(r["tokens"]) + r["alone"] == r["size"] for r in held["ordered"].collect())


@pytest.mark.parametrize("n", [1, 3, 12])
def test_grams_are_counted_inside_the_row(spark, monkeypatch, n):
    import collections

    texts = ["abcabcabc", "", None, "Ab  \t cab", "aüß中\U0001f600x\U0001f600", "x\x00x\x00", "abc" * 40, "q"]
    monkeypatch.setattr(similarity, "GRAM_LETTERS", 16)
    want = {}
    for i, text in enumerate(texts):
        flat = " ".join((text or "").lower().split())
        want |= {(i, g): c for g, c in collections.Counter(flat[k : k + n] for k in range(len(flat) - n + 1)).items()}
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id INT, sequence STRING")
    counts = similarity.gram_counts(df, n)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r["entry_id"], r["gram"]): r["n"] for r in counts.collect()} == want
    # an entry with several rows has one count a gram
    twice = {(r["entry_id"], r["gram"]): r["n"] for r in similarity.gram_counts(df.union(df), n).collect()}
    assert twice == {k: 2 * c for k, c in want.items()}
    hashed = {}
    for (i, g), c in want.items():
        key = (i, int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 5)
        hashed[key] = hashed.get(key, 0) + c
    got = {(r["entry_id"], r["gram"]): r["w"] for r in similarity.gram_vector(df, n, 5).collect()}
    norm = lambda i: sum(c * c for (e, _), c in hashed.items() if e == i) ** 0.5
    assert got == pytest.approx({(i, b): c / norm(i) for (i, b), c in hashed.items()})


def test_mean_of_contacts_sends_each_contact_once(spark, tmp_path):
    from termweave.catalog.registry import Inputs
    from termweave.operators import graph

    data = [(1, 0, 1, 0.4), (1, 1, 0, 0.2), (1, 2, 2, 0.5), (1, 3, 1, 0.6), (1, None, 2, 0.8), (None, 4, 5, 0.1), (1, 6, 7, None)]
    df = spark.createDataFrame(data, "entry_id INT, i INT, j INT, p DOUBLE")
    got = {(r["entry_id"], r["i"], r["j"]): r["p"] for r in graph.symmetrise_mean(df).collect()}
    want = {(1, 2, 2): 0.5, (1, 1, 3): 0.3, (1, 3, 1): 0.3, (1, None, 2): 0.4, (1, 2, None): 0.4, (None, 4, 5): 0.05, (None, 5, 4): 0.05}
    want |= {(1, 0, 1): 0.3, (1, 1, 0): 0.3, (1, 6, 7): None, (1, 7, 6): None}
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())
    contacts = Inputs(spark, "/root/testdata/sf0.001").contacts()
    made = graph.contact_graph(contacts, contacts.select("entry_id").distinct().withColumn("length", F.lit(64)), mutual=False)
    plan = graph.symmetrise_mean(contacts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and made.count() > 0


def test_rows_are_dealt_into_as_many_partitions_as_they_ask_for(spark):
    from termweave.sources.tables import dealt_by

    df = spark.range(10_000).select((F.col("id") % 500).alias("k"))
    assert dealt_by(df, "k", 300).rdd.getNumPartitions() == 34


def test_top_p_of_short_and_long_rows_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(e, int(i), j, float(rng.integers(0, 6)) / 2) for e in (1, 2, None) for i in rng.integers(0, 4, 3) for j in range(int(rng.integers(1, 30)))]
    data += [(3, 0, 1, None), (3, 0, 2, float("nan"))]
    df = spark.createDataFrame(data, "entry_id INT, src INT, dst INT, weight DOUBLE").dropDuplicates(["entry_id", "src", "dst"])
    df = spark.createDataFrame(df.collect(), df.schema)
    found = {}
    for limit in (0, 8, 1000):
        monkeypatch.setattr(ranking, "ROW_EDGES", limit)
        got = ranking.top_p(df, 0.6)
        found[limit] = {(r["entry_id"], r["src"], r["dst"]): round(r["weight"], 9) for r in got.collect()}
    assert found[0] == found[8] == found[1000] and len(found[0]) > 20
    plan = ranking.top_p(df, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_embeddings_leave_python_as_whole_columns(spark, monkeypatch):
    from termweave.operators import inference

    monkeypatch.setattr(inference, "BATCH_VALUES", 16)

    def make():
        return lambda texts: [np.arange(len(t) * 3, dtype=np.float32).reshape(-1, 3) for t in texts]

    texts = ["abcd", "", "x", "abcdefghij", "yz"]
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id INT, sequence STRING").coalesce(1)
    made = inference.embed(df, make, batch_size=3, cached=df.filter("entry_id = 2"))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = {r["entry_id"]: (r["length"], r["vec"]) for r in made.collect()}
    assert got == {i: (len(t), np.arange(len(t) * 3, dtype=float).reshape(-1, 3).tolist()) for i, t in enumerate(texts) if i != 2}


def test_only_usable_atoms_of_structures_are_grouped(spark, monkeypatch):
    from termweave.plans import pipelines

    held = {}
    keep = pipelines.written
    monkeypatch.setattr(pipelines, "written", lambda df, name: held.setdefault(name, keep(df, name)))
    entries = spark.createDataFrame([(1, 2), (2, 9)], "entry_id INT, length INT")
    frags = spark.createDataFrame([(1, "1-a", "m1", 1, 2), (1, "1-b", "m2", 1, 5), (2, "2-a", "m3", 1, 3)], "entry_id INT, accession STRING, model_id STRING, start INT, length INT")
    atoms = spark.createDataFrame([(m, k, 3.8 * k, 0.0, 0.0, 50.0) for m, n in (("m1", 2), ("m2", 5), ("m3", 3)) for k in range(n)], "model_id STRING, pos INT, x DOUBLE, y DOUBLE, z DOUBLE, conf DOUBLE")
    edges = spark.createDataFrame([(2, 0, 1, 0.5)], "entry_id INT, src INT, dst INT, weight DOUBLE")
    nodes = spark.createDataFrame([(2, 0, 0.5)], "entry_id INT, pos INT, conf DOUBLE")
    done = pipelines.structure_graphs(entries, frags, atoms, edges, nodes)
    assert sorted(tuple(r) for r in done.edges.collect()) == [(1, 0, 1, 0.5), (1, 1, 0, 0.5), (2, 0, 1, 0.5)]
    assert {r["model_id"] for r in held["atoms"].collect()} == {"m1"}


def test_annotations_are_dealt_once_for_labels(spark):
    vocab = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "term BIGINT, idx BIGINT")
    notes = spark.createDataFrame([(1, 30), (1, 10), (1, 30), (2, 7), (3, None), (None, 10)], "entry_id BIGINT, term BIGINT")
    sparse = labels.label_indices(notes, vocab)
    assert _deals(sparse, "entry_id", "term") == 0 and _deals(sparse, "entry_id") == 1
    got = {r["entry_id"]: (r["size"], r["indices"]) for r in sparse.collect()}
    assert got == {1: (3, [0, 2]), 2: (3, []), 3: (3, []), None: (3, [])}


def test_vectors_of_a_centroid_are_added_up_before_they_travel(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abcabd", "bcab", None, "", "aüß中x", "abc"])], "entry_id INT, sequence STRING").coalesce(1)
    want = {}
    for r in similarity.gram_vector(df).collect():
        want[r["gram"]] = want.get(r["gram"], 0.0) + r["w"]
    sums = similarity._gram_sums(df, 3, None).collect()
    assert len(sums) == len(want) and {r["gram"]: r["w"] for r in sums} == pytest.approx(want)


def _tree(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _small_files(spark, folder):
    """An ontology of a few rows, in files that are far below the size up to which Spark broadcasts."""
    spark.createDataFrame([(i, i // 2) for i in range(2, 60)], "child BIGINT, parent BIGINT").write.parquet(f"{folder}/edges")
    spark.createDataFrame([(i, "CP"[i % 3 == 0]) for i in range(1, 60)], "term BIGINT, aspect STRING").write.parquet(f"{folder}/terms")
    return spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/terms")


def test_ontology_and_closure_are_not_broadcast(spark, monkeypatch, tmp_path):
    edges, terms = _small_files(spark, tmp_path)
    rounds, keep = [], dag.written
    monkeypatch.setattr(dag, "written", lambda df, name: (rounds.append(_tree(df)), keep(df, name))[1])
    above, below = dag.ancestors(edges, terms), dag.descendants(edges, terms)
    assert len(rounds) > 6 and not [p for p in [*rounds, _tree(above), _tree(below)] if "Broadcast" in p]
    aspect = lambda i: "CP"[i % 3 == 0]
    want = {(i, i >> k) for i in range(2, 60) for k in range(1, 6) if i >> k and aspect(i) == aspect(i >> k)}
    assert {tuple(r) for r in above.collect()} == want


def test_a_vocabulary_meets_the_ontology_without_broadcasting_it(spark, monkeypatch, tmp_path):
    edges, terms = _small_files(spark, tmp_path)
    links, keep = [], dag.written
    monkeypatch.setattr(dag, "written", lambda df, name: (links.append((name, _tree(df))), keep(df, name))[1])
    counts = spark.createDataFrame([(48, 5), (45, 4), (50, 3)], "term BIGINT, n BIGINT")
    vocab = dag.close_vocabulary(counts, edges, terms, 1)
    fixed = [p for name, p in links if name == "links"] + [links[1][1], _tree(vocab)]  # the ontology's own rows, the first terms, the result
    assert len(fixed) == 3 and links[1][0] == "climbed" and not [p for p in fixed if "Broadcast" in p]
    assert {tuple(r) for r in vocab.collect()} == {("P", 48), ("P", 24), ("P", 12), ("P", 6), ("P", 3), ("C", 50), ("C", 25), ("C", 1)}
    inside = _tree(dag.vocab_adjacency(vocab, edges))
    assert inside.count("SortMergeJoin") >= 2


def test_batches_of_a_stream_share_one_written_closure(spark, monkeypatch, tmp_path):
    from termweave.streaming import incremental

    schema = "entry_id BIGINT, term BIGINT, score DOUBLE"
    held, plans, keep, spread = [], [], incremental.written, dag.propagate_scores
    monkeypatch.setattr(incremental, "written", lambda df, name: held.append(name) or keep(df, name))
    monkeypatch.setattr(dag, "propagate_scores", lambda rows, closure: (plans.append(_tree(out := spread(rows, closure))), out)[1])
    spark.createDataFrame([(e, 48, e / 8.0) for e in range(1, 5)], schema).repartition(2).write.parquet(str(tmp_path / "in"))
    edges, terms = _small_files(spark, tmp_path)
    incremental_finalize(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), dag.ancestors(edges, terms), schema, max_files=1)
    assert held == ["closure"] and len(plans) == 2 and not [p for p in plans if "Broadcast" in p]
    done = incremental.read_finished(spark, str(tmp_path / "out")).collect()
    assert {(r["entry_id"], r["term"], r["score"]) for r in done} == {(e, t, e / 8.0) for e in range(1, 5) for t in (48, 24, 12, 6, 3)}


def test_residues_dealt_by_entry_meet_where_they_are(spark):
    from termweave.operators import graph

    rng = np.random.default_rng(5)
    rows = [(e, k, *(float(x) for x in rng.normal(0, 9, 3))) for e in range(4) for k in range(40)]
    rows += [(1, 7, *rows[47][2:]), (2, None, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0), (3, 99, None, 0.0, 0.0)]
    coords = spark.createDataFrame(rows, "entry_id INT, pos INT, x DOUBLE, y DOUBLE, z DOUBLE").repartition(3, "entry_id")
    pairs = graph.pairs_within(coords, 6.0)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the repartition
    whole = [r for r in rows if None not in r]
    near = lambda a, b: sum((u - v) ** 2 for u, v in zip(a[2:], b[2:])) ** 0.5 <= 6.0
    want = sorted((a[0], a[1], b[1]) for a, b in itertools.product(whole, whole) if a[0] == b[0] and a[1] != b[1] and near(a, b))
    got = [(r["entry_id"], r["i"], r["j"]) for r in pairs.collect()]
    assert sorted(r for r in got if None not in r) == want and not [r for r in got if r[0] is None]


def test_a_sieve_keeps_every_key_and_few_others(spark, tmp_path):
    from termweave.operators import relational

    rows = spark.range(20000).select(F.col("id").cast("string").alias("name"), (F.col("id") % 3).alias("part"), F.lit(1).alias("v"))
    rows.filter("name LIKE '%77'").select("name", "part").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    kept = relational.sieved(rows, keys, ["name", "part"])
    assert kept.columns == rows.columns and "Exchange hashpartitioning(name" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.join(keys, ["name", "part"], "left_semi").count() == keys.count() == 200
    assert kept.count() < 200 + 20000 * 0.1
    assert relational.sieved(rows, keys.limit(0), ["name"]).count() == 0
    other = keys.select(F.col("part").cast("int").alias("part"))  # hashes differ by type
    assert relational.sieved(rows, other, ["part"]).count() == 20000


def test_equal_labels_are_written_once_a_file(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(labels, "TASK_TEXT", 1 << 23)
    width = 60000
    # a third of the entries have no label, 64 sets belong to some 10 entries each, and 30 to one alone
    sets = {e: [] if e % 3 == 0 else [e % 64, 64 + e % 64] for e in range(960)} | {1000 + e: [200 + e] for e in range(30)} | {None: []}
    sparse = spark.createDataFrame([(e, width, x) for e, x in sets.items()], "entry_id INT, size INT, indices ARRAY<BIGINT>")
    dealt = labels.side_by_side(sparse)
    assert dealt.columns == sparse.columns
    assert {r["entry_id"]: list(r["indices"]) for r in dealt.collect()} == sets and dealt.count() == len(sets)
    at = [(r["p"], tuple(r["indices"])) for r in dealt.filter("entry_id < 1000").select(F.spark_partition_id().alias("p"), "indices").collect()]
    tasks = {s: len({p for p, x in at if x == s}) for _, s in at}
    assert max(n for s, n in tasks.items() if s) == 1 and 1 < tasks[()] <= 3  # 321 times 60,000 bytes
    for name, rows in (("before", sparse.repartition(2)), ("now", dealt)):
        labels.label_text(rows).write.parquet(str(tmp_path / name))
    size = {name: sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) for name in ("before", "now")}
    assert size["now"] < size["before"] / 3
    assert labels.side_by_side(sparse.limit(0)).count() == 0


def test_places_travel_as_gaps():
    rng = np.random.default_rng(3)
    for top, n in ((50, 40), (1 << 28, 1000), (1 << 28, 3)):
        places = np.unique(np.concatenate([rng.integers(0, top, n), [0, 65534, 65535, 65536, 131070]])).astype(np.uint64)
        sent = similarity._coded(places)
        assert similarity._decoded(sent).tolist() == places.tolist()
    assert len(similarity._coded(np.arange(0, 1 << 20, 300, dtype=np.uint64))) == 2 * len(range(0, 1 << 20, 300))
    assert len(similarity._decoded(similarity._coded(np.zeros(0, np.uint64)))) == 0


def test_texts_are_verified_without_sending_their_tokens(spark, monkeypatch):
    held = {}
    keep = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: held.setdefault(name, keep(df, name)))
    words = ["".join(np.random.default_rng(k).choice(list("abcdefgh"), 400)) for k in range(12)]
    rows = list(enumerate(words + [w[:350] + w[::-1][:60] for w in words[:6]] + [None, "", words[0]])) + [(None, words[1])]
    df = spark.createDataFrame(rows, "entry_id INT, sequence STRING")
    similar, members = similarity.text_representatives(df, lambda x: similarity.shingle_sets(x, 8), 0.5)
    assert {(r["entry_id_a"], r["entry_id_b"]) for r in held["candidates"].collect()} >= {(k, 12 + k) for k in range(6)}
    assert "_x" not in "".join(line for line in similar._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    sets = {k: {t[i : i + 8].lower() for i in range(len(t) - 7)} for k, t in rows if t and k is not None}
    want = {(k, 12 + k): len(sets[k] & sets[12 + k]) / len(sets[k] | sets[12 + k]) for k in range(6)}
    assert {(r["a"], r["b"]): r["weight"] for r in similar.collect()} == pytest.approx(want)
    assert held["ordered"].schema["tokens"].dataType.simpleString() == "array<int>"


def test_short_lists_are_merged_without_comparing_all_with_all(spark, monkeypatch):
    compared, keep = [], F.array_distinct
    monkeypatch.setattr(F, "array_distinct", lambda c: compared.append(c) or keep(c))  # it compares structs pairwise
    # every pair shares all tokens, so that each of the lists of a set names the same others
    rows = [(e, list(range(9)), 3 + e % 2) for e in range(7)]
    ordered = spark.createDataFrame([(e, size, tokens) for e, tokens, size in rows], "entry_id BIGINT, size INT, tokens ARRAY<BIGINT>")
    near = {r["a"]: [(x["size"], x["b"]) for x in r["near"]] for r in similarity._by_one_token(ordered, 3).collect()}
    assert near == {e: sorted((size, b) for b, _, size in rows if b != e)[:4] for e, _, _ in rows}
    assert not compared
