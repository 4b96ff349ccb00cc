"""Operators on small fixtures with known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.functions import arrays as ax
from termweave.functions import text as fx
from termweave.operators import dag, graph, inference, labels, metrics, ranking, relational, reports, similarity


def test_score_text_is_python_format(spark):
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.random(300)] + [0.1245, 0.5, 0.9995, 0.99949, 1.0, 1.7, 0.0125, 0.1235, 0.0001, 9.999e-5, 1.2345e-7, 0.001, 0.01]
    values += [k / 2000 for k in range(1, 2000, 7)] + [0.0, -1.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for v, text in df.select("v", fx.score_text(F.col("v"))).collect():
        want = None if (math.isnan(v) or math.isinf(v) or v <= 0) else f"{min(v, 1.0):.3g}"
        assert text == want, v


def test_aspects(spark):
    df = spark.createDataFrame([("c",), ("B.P.O.",), ("zz top",)], "a STRING")
    assert [r[0] for r in df.select(fx.normalise_aspect(F.col("a"))).collect()] == ["C", "P", "zz top"]
    assert [r[0] for r in df.select(fx.normalise_aspect_letter(F.col("a"))).collect()] == ["C", "B", "Z"]


def test_text_functions(spark, rows):
    df = spark.createDataFrame([("a", " acdb "), ("b", "")], "entry_id STRING, sequence STRING")
    assert rows(df.select(fx.clean_sequence(F.col("sequence")))) == [("",), ("ACDX",)]
    assert df.select(fx.space_residues(F.lit("AUB"), "<p>")).first()[0] == "<p> A X X"
    assert rows(fx.chunk_sequence(df.withColumn("sequence", F.trim("sequence")), 3)) == [("a", 0, "acd"), ("a", 1, "b")]
    assert rows(fx.ngrams(spark.createDataFrame([("a", "ABCD")], "entry_id STRING, sequence STRING"))) == [("a", "abc"), ("a", "bcd")]
    key = df.select(fx.artefact_key(F.lit("a/b")), fx.artefact_key(F.lit(""))).first()
    assert key[0].startswith("a_b_") and len(key[0]) == 12 and key[1].startswith("protein_")


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.05] * 20, [1.0] + [0.0] * 19)], "v ARRAY<DOUBLE>, u ARRAY<DOUBLE>, o ARRAY<DOUBLE>")
    row = df.select(
        ax.fit_length(F.col("v"), 2), ax.fit_length(F.col("v"), 5), ax.entropy_confidence(F.col("u")), ax.entropy_confidence(F.col("o")),
        ax.take(F.col("v"), [2, 0]), ax.finite_array(F.array(F.lit(float("nan")), F.lit(float("-inf")), F.lit(2.0))),
    ).first()
    assert row[0] == [1.0, 2.0] and row[1] == [1.0, 2.0, 3.0, 0.0, 0.0]
    assert abs(row[2]) < 1e-9 and abs(row[3] - 1) < 1e-6
    assert row[4] == [3.0, 1.0] and row[5] == [0.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        ax.take(F.col("v"), [0, 1], expected=20)


TERMS = [("1", "F"), ("2", "F"), ("3", "F"), ("4", "P"), ("5", "F")]
EDGES = [("1", "3", "is_a"), ("2", "1", "part_of"), ("5", "4", "is_a"), ("4", "3", "is_a"), ("2", "99", "is_a")]


def _onto(spark):
    return spark.createDataFrame(TERMS, "term STRING, aspect STRING"), spark.createDataFrame(EDGES, "child STRING, parent STRING, rel STRING")


def test_closures_are_asymmetric(spark, rows):
    terms, edges = _onto(spark)
    # 5 reaches 3 through the other-aspect node 4; the way down does not pass it
    assert rows(dag.ancestors(edges, terms)) == [("1", "3"), ("2", "1"), ("2", "3"), ("5", "3")]
    assert rows(dag.descendants(edges, terms)) == [("1", "2"), ("3", "1"), ("3", "2")]


def test_vocabulary_and_adjacency(spark, rows):
    terms, edges = _onto(spark)
    freq = spark.createDataFrame([("1", 5), ("2", 5), ("3", 1), ("77", 9)], "term STRING, n BIGINT")
    vocab = dag.close_vocabulary(freq, edges, terms, 2)
    assert rows(vocab) == [("F", "1"), ("F", "2"), ("F", "3")]
    adjacency = dag.vocab_adjacency(vocab, edges)
    assert rows(adjacency) == [("F", "1", "2", 1.0), ("F", "3", "1", 1.0)]
    labelled = spark.createDataFrame([("e", "2")], "entry_id STRING, term STRING")
    assert rows(dag.propagate_labels(labelled, dag.vocab_closure(adjacency))) == [("e", "1"), ("e", "2"), ("e", "3")]


def test_closure_of_cycles_and_diamonds_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child STRING, parent STRING")
    assert dag.reach(edges).count() == 12


def test_score_propagation_and_specific(spark, rows):
    terms, edges = _onto(spark)
    scores = spark.createDataFrame([("e", "2", 0.4), ("e", "1", 0.4), ("e", "3", 0.6), ("f", "1", 0.2)], "entry_id STRING, term STRING, score DOUBLE")
    up = dag.propagate_ontology(scores, dag.ancestors(edges, terms))
    assert rows(up) == [("e", "1", 0.4), ("e", "2", 0.4), ("e", "3", 0.6), ("f", "1", 0.2), ("f", "3", 0.2)]
    assert rows(dag.most_specific(scores, dag.descendants(edges, terms))) == [("e", "2", 0.4), ("e", "3", 0.6), ("f", "1", 0.2)]


def test_labels_decode_to_the_same_places(spark, rows):
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(7)], "term STRING, idx BIGINT")
    data = {"A": [0, 6], "B": [3], "C": [], "D": list(range(7))}
    notes = spark.createDataFrame([(e, f"t{i}") for e, x in data.items() for i in [*x, *x]] + [("C", "unknown")], "entry_id STRING, term STRING")
    sparse = labels.label_indices(notes, vocab)
    assert rows(sparse) == [(e, 7, x) for e, x in data.items()]
    places = {e: [int(i in x) for i in range(7)] for e, x in data.items()}
    assert dict(rows(labels.dense_labels(sparse))) == places
    assert dict(rows(labels.label_text(sparse))) == {e: "".join(map(str, x)) for e, x in places.items()}
    nothing = labels.label_indices(notes, vocab.limit(0))
    assert set(rows(nothing, "size", "indices")[0][1]) == set() and {r[1] for r in rows(labels.label_text(nothing))} == {""}


def test_multi_hot(spark, rows):
    notes = spark.createDataFrame([("A", "GO:1"), ("A", "GO:2"), ("B", "GO:2")], "entry_id STRING, term STRING")
    vocab = spark.createDataFrame([("GO:1", 0), ("GO:2", 1), ("GO:3", 2)], "term STRING, idx BIGINT")
    assert rows(labels.multi_hot(notes, vocab)) == [("A", [1, 1, 0]), ("B", [0, 1, 0])]
    more = spark.createDataFrame([("C",)], "entry_id STRING")
    assert rows(labels.multi_hot(notes, vocab, more)) == [("C", [0, 0, 0])]


def _scored(spark):
    probs, truth = [[0.9, 0.2, 0.6], [0.4, 0.8, 0], [0.3, 0.3, 0.3]], [[1, 0, 1], [0, 1, 0], [0, 0, 0]]
    data = [(e, t, float(probs[e][t]), truth[e][t]) for e in range(3) for t in range(3) if probs[e][t] or truth[e][t]]
    return spark.createDataFrame(data, "entry_id INT, term INT, score DOUBLE, label INT")


def test_pr_curve_worked_example(spark):
    curve = {r["tau"]: r for r in metrics.pr_curve(_scored(spark), [0.1, 0.3, 0.5], 3).collect()}
    for tau, p, r, f in ((0.1, 0.388889, 0.666667, 0.491228), (0.3, 0.5, 0.666667, 0.571429), (0.5, 1.0, 0.666667, 0.8)):
        assert np.allclose([curve[tau]["precision"], curve[tau]["recall"], curve[tau]["f"]], [p, r, f], atol=1e-6)
    best = metrics.fmax(metrics.pr_curve(_scored(spark), [0.1, 0.3, 0.5], 3)).first()
    assert abs(best["fmax"] - 0.8) < 1e-9 and best["tau"] == 0.5


def test_pr_curve_without_predictions(spark):
    none = metrics.fmax(metrics.pr_curve(_scored(spark), [0.95, 0.99], 3)).first()
    assert (none["fmax"], none["precision"], none["recall"], none["tau"]) == (0.0, 0.0, 0.0, 0.95)
    every = metrics.pr_curve(_scored(spark), [0.0], 3, n_terms=3).first()
    assert every["cov"] == 3 and abs(every["precision"] - 3 / 9) < 1e-9 and abs(every["recall"] - 2 / 3) < 1e-9
    with pytest.raises(ValueError):
        metrics.pr_curve(_scored(spark), [0.0], 3)


def _reference_ap_auc(scores, truth):
    pos, neg = scores[truth == 1], scores[truth == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = 0.0
    for s in sorted(set(scores), reverse=True):
        at = scores >= s
        ap += truth[scores == s].sum() / truth.sum() * truth[at].sum() / at.sum()
    return ap, auc


def test_ap_and_auc_with_absent_rows(spark):
    rng = np.random.default_rng(0)
    scores = np.round(rng.random(60), 1)
    truth = (rng.random(60) < 0.3).astype(int)
    stored = [(i, 0, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, truth)) if s > 0 or y]
    df = spark.createDataFrame(stored, "entry_id INT, term INT, score DOUBLE, label INT")
    ap, auc = _reference_ap_auc(scores, truth)
    assert abs(metrics.average_precision(df, 60).first()["ap"] - ap) < 1e-9
    assert abs(metrics.roc_auc(df, 60).first()["auc"] - auc) < 1e-9


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 2.0)], "x DOUBLE, y DOUBLE, w DOUBLE")
    plain = metrics.mean_loss(df, ax.bce(F.col("x"), F.col("y"))).first()[0]
    weighed = metrics.mean_loss(df, ax.bce(F.col("x"), F.col("y"), F.col("w"))).first()[0]
    a, b = math.log(2), math.log1p(math.exp(-1))
    assert abs(plain - (a + b) / 2) < 1e-12 and abs(weighed - (a + 2 * b) / 2) < 1e-12


def test_coordinate_graph(spark, rows):
    df = spark.createDataFrame(
        [("P", i, 0.0, 0.0, z, c) for i, (z, c) in enumerate([(0.0, 100.0), (4.0, 50.0), (9.0, 80.0), (20.0, 30.0)])],
        "entry_id STRING, pos BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, conf DOUBLE",
    )
    got = rows(graph.coordinate_graph(df, 10.0, 2), "src", "dst", "weight")
    assert got == [(0, 1, 0.5), (1, 0, 0.5), (1, 2, 0.5), (2, 1, 0.5)]


def test_pairs_within_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(0, 8, (120, 3))
    df = spark.createDataFrame([("P", i, *map(float, p)) for i, p in enumerate(pts)], "entry_id STRING, pos BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")
    got = {(r["i"], r["j"]) for r in graph.pairs_within(df, 6.0).collect()}
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    assert got == {(i, j) for i in range(120) for j in range(120) if i != j and d[i, j] <= 6.0}


def test_symmetric_normalise_with_confidence_loops(spark):
    edges = spark.createDataFrame([("g", 0, 1, 0.5), ("g", 1, 0, 0.5), ("g", 1, 2, 0.25), ("g", 2, 1, 0.25)], "entry_id STRING, src BIGINT, dst BIGINT, weight DOUBLE")
    nodes = spark.createDataFrame([("g", 0, 0.2), ("g", 1, 0.4), ("g", 2, 0.6)], "entry_id STRING, pos BIGINT, conf DOUBLE")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.symmetric_normalise(graph.confidence_loops(edges, nodes)).collect()}
    m = np.array([[0.2, 0.5, 0], [0.5, 0.4, 0.25], [0, 0.25, 0.6]])
    d = m.sum(1)
    for (i, j), w in got.items():
        assert abs(w - m[i, j] / math.sqrt(d[i] * d[j])) < 1e-12
    assert len(got) == 7


def test_stochastic_prior_and_diffusion_match_dense(spark):
    rng = np.random.default_rng(2)
    n = 6
    s = np.where(rng.random((n, n)) < 0.4, rng.random((n, n)), 0.0)
    edges = spark.createDataFrame([("g", int(i), int(j), float(s[i, j])) for i, j in zip(*np.nonzero(s))], "entry_id STRING, src BIGINT, dst BIGINT, weight DOUBLE")
    x = rng.random((n, 2))
    nodes = spark.createDataFrame([("g", i, [float(v) for v in x[i]]) for i in range(n)], "entry_id STRING, pos BIGINT, vec ARRAY<DOUBLE>")
    dense = np.maximum(s + np.eye(n), 1e-6)
    forward = dense / dense.sum(1, keepdims=True)
    out = {r["pos"]: r["vec"] for r in graph.diffuse(graph.stochastic_prior(edges, nodes), nodes, 3, 2).collect()}
    want = np.linalg.matrix_power(forward, 3) @ x
    assert np.allclose([out[i] for i in range(n)], want, atol=1e-9)


def test_pooling(spark):
    data = [("a", 0, [1.0, 2.0], 1), ("a", 1, [3.0, 4.0], 0), ("b", 0, [5.0, 6.0], 0)]
    df = spark.createDataFrame(data, "entry_id STRING, pos INT, vec ARRAY<DOUBLE>, mask INT")
    get = lambda d: {r["entry_id"]: r["vec"] for r in d.collect()}
    for dim in (2, None):
        assert get(graph.pool(df, "mean", dim)) == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
        assert get(graph.pool(df, "masked_mean", dim)) == {"a": [1.0, 2.0], "b": [0.0, 0.0]}
        assert get(graph.softmax_pool(df, [1.0, 0.0], dim)) == {"a": [1.0, 2.0], "b": [0.0, 0.0]}
    assert get(graph.pool(df, "first"))["a"] == [1.0, 2.0]
    with pytest.raises(ValueError):
        graph.pool(df, "median")


def test_merge_and_pad(spark, rows):
    edges = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 0, 1.0), ("b", 1, 2, 1.0)], "entry_id STRING, src BIGINT, dst BIGINT, weight DOUBLE")
    nodes = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(5)], "entry_id STRING, pos BIGINT")
    batches = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "batch_id BIGINT, pos BIGINT, entry_id STRING")
    assert rows(graph.merge_graphs(edges, nodes, batches), "src", "dst") == [(0, 1), (1, 0), (4, 5)]
    assert rows(graph.node_offsets(nodes, batches), "first_node", "n_nodes") == [(0, 3), (3, 5)]
    vecs = spark.createDataFrame([("a", [1.0] * 3), ("b", [2.0] * 5)], "entry_id STRING, vec ARRAY<DOUBLE>")
    padded = {r["entry_id"]: r for r in ranking.pad_batches(vecs, batches).collect()}
    assert padded["a"]["padded"] == [1.0, 1.0, 1.0, 0.0, 0.0] and padded["a"]["mask"] == [1, 1, 1, 0, 0]


def test_isoforms_and_gaps(spark, rows):
    frags = spark.createDataFrame(
        [("P12345", "P12345-2", 1, 1, 3, 3), ("P12345", "P12345-2", 2, 4, 5, 2), ("P12345", "P12345-3", 3, 1, 4, 4)],
        "entry_id STRING, accession STRING, frag_no INT, start_pos INT, end_pos INT, length INT",
    )
    lengths = spark.createDataFrame([("P12345", 5)], "entry_id STRING, length BIGINT")
    assert rows(graph.match_isoforms(frags, lengths)) == [("P12345", "P12345-2", 5)]
    assert rows(ranking.pick_isoform(frags), "accession", "priority") == [("P12345-2", 1)]
    assert ranking.fragment_gaps(frags).count() == 0


def test_min_length_then_batches(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 3), ("d", None)], "entry_id STRING, length BIGINT")
    kept, dropped = relational.min_length(df, 2)
    assert kept.count() == 3 and dropped.first()[0] == 1
    batches = ranking.length_batches(kept.filter("length IS NOT NULL"), 2)
    assert [r["batch_id"] for r in batches.collect()] == [0, 0]


def test_top_p_rows_sum_to_one(spark):
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(5, 7))
    df = spark.createDataFrame([("g", i, j, float(logits[i, j])) for i in range(5) for j in range(7)], "entry_id STRING, src BIGINT, dst BIGINT, weight DOUBLE")
    got = np.zeros((5, 7))
    for r in ranking.top_p(df, 0.6).collect():
        got[r["src"], r["dst"]] = r["weight"]
    assert np.allclose(got.sum(1), 1) and (got >= 0).all()
    for i in range(5):
        p = np.exp(logits[i]) / np.exp(logits[i]).sum()
        k = int((np.cumsum(np.sort(p)[::-1]) < 0.6).sum()) + 1
        assert (got[i] > 0).sum() == k


def test_best_and_final(spark, rows):
    log = spark.createDataFrame(
        [("r", 1, "train/loss", 0.5), ("r", 2, "train/loss", 0.4), ("r", 1, "pr_auc", 0.2), ("r", 2, "pr_auc", 0.3), ("r", 3, "pr_auc", float("nan"))],
        "run_id STRING, step INT, metric STRING, value DOUBLE",
    )
    got = rows(reports.metric_summary(log, {"train/loss": "min", "pr_auc": "max"}))
    assert got == [("r", "pr_auc", 0.3, 0.3), ("r", "train/loss", 0.4, 0.4)]


def test_split_sizes_and_strata(spark):
    def sizes(n, **ratios):
        row = spark.range(n).agg(*[c.alias(name) for name, c in ranking.split_sizes(F.count(F.lit(1)), ratios).items()])
        return tuple(row.first())

    assert sizes(11, train=0.8, val=0.1, test=0.1) == (9, 1, 1)
    assert sizes(19, train=0.8, val=0.1, test=0.1) == (16, 2, 1)
    assert sizes(0, train=0.8, val=0.1, test=0.1) == (0, 0, 0)
    assert sizes(5, train=1, val=1, test=1) == (2, 2, 1)
    assert sizes(2, train=1, val=3, test=3) == (0, 1, 1)
    with pytest.raises(ValueError):
        sizes(5)
    with pytest.raises(ValueError):
        ranking.bucket_edges((1, -1, 1))


def test_split_by_key_and_a_train_split_that_takes_a_row(spark):
    df = spark.createDataFrame([("a", f"p{i}") for i in range(10)] + [("b", "q1"), ("b", "q2")], "aspect STRING, entry_id STRING")
    got = ranking.split(df, {"train": 0.2, "val": 0.4, "test": 0.4}, 1, ["aspect"])
    counts = {(r["aspect"], r["split"]): r["count"] for r in got.groupBy("aspect", "split").count().collect()}
    assert counts == {("a", "train"): 2, ("a", "val"): 4, ("a", "test"): 4, ("b", "train"): 1, ("b", "test"): 1}


def test_top_terms_with_a_number_for_each_aspect(spark, rows):
    freq = spark.createDataFrame([(a, t, n) for a in "CFP" for t, n in ((1, 5), (2, 7), (3, 7))], "aspect STRING, term INT, n INT")
    assert rows(ranking.top_terms(freq, {"C": 1, "F": 2}), "aspect", "term") == [("C", 2), ("F", 2), ("F", 3), ("P", 1), ("P", 2), ("P", 3)]
    assert ranking.top_terms(freq, {"C": 0}).count() == ranking.top_terms(freq, 0).count() == 9


def test_fallback_strict_raises(spark):
    entries = spark.createDataFrame([("a",)], "entry_id STRING")
    primary = spark.createDataFrame([], "entry_id STRING, n_items BIGINT, length_ok BOOLEAN, file_ok BOOLEAN")
    second = spark.createDataFrame([], "entry_id STRING")
    assert relational.with_fallback(entries, primary, second).first()["source"] == "none"
    with pytest.raises(Exception, match="no source for entry a"):
        relational.with_fallback(entries, primary, second, strict=True).collect()
    with pytest.raises(Exception, match="missing x for entry a"):
        relational.assemble(entries, {"x": second.withColumn("v", F.lit(1))}, "error").collect()


def test_embed_checks_length(spark):
    df = spark.createDataFrame([("a", "AAA"), ("b", "CC")], "entry_id STRING, sequence STRING")
    good = inference.embed(df, lambda: lambda texts: [np.ones((len(t), 2)) for t in texts], cached=df.filter("entry_id = 'b'").select("entry_id"))
    assert [(r["entry_id"], r["length"]) for r in good.collect()] == [("a", 3)]
    with pytest.raises(Exception, match="rows for"):
        inference.embed(df, lambda: lambda texts: [np.ones((1, 2)) for _ in texts]).collect()


def test_cosine_distance_shape(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(0, i, [float(v) for v in rng.normal(size=8)]) for i in range(3)], "batch_id BIGINT, entry_id BIGINT, vec ARRAY<DOUBLE>")
    m = np.array([r["distances"] for r in similarity.cosine_distance(df).orderBy("entry_id").collect()])
    assert np.allclose(m, m.T) and np.allclose(np.diag(m), 0)
    assert similarity.cosine_graph(df, method="identity").count() == 3
    with pytest.raises(ValueError):
        similarity.cosine_graph(df, method="other")


def test_a_vocabulary_climbs_as_far_as_the_closure(spark, rows, monkeypatch):
    aspects = {i: "CFP"[i % 7 % 3] for i in range(60)} | {3: None}
    terms = spark.createDataFrame(list(aspects.items()), "term BIGINT, aspect STRING")
    links = [(i, i - 1) for i in range(1, 60)] + [(i, i // 3) for i in range(1, 60)] + [(0, 59), (8, 99), (99, 2), (5, None)]
    edges = spark.createDataFrame(links, "child BIGINT, parent BIGINT")
    freq = spark.createDataFrame([(i, i % 5) for i in range(0, 60, 3)] + [(99, 9)], "term BIGINT, n BIGINT")
    whole = dag.ancestors(edges, terms)
    order = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    for top_k in (None, 1, {"C": 2, "F": 1}):
        want = order(dag.close_vocabulary(freq, edges, terms, top_k, whole))
        for levels in (2, 32):
            monkeypatch.setattr(dag, "LEVELS", levels)
            with monkeypatch.context() as m:
                if levels == 32:  # nothing but what lies above the chosen terms
                    m.setattr(dag, "ancestors", None)
                assert order(dag.close_vocabulary(freq, edges, terms, top_k)) == want


def test_limits_by_aspect_drop_terms_before_they_are_dealt(spark):
    freq = spark.createDataFrame([("C", i, i % 4) for i in range(9)], "aspect STRING, term BIGINT, n BIGINT")
    plan = ranking.top_terms(freq, {"C": 3, "F": 1})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
