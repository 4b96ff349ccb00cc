import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import near_vectors as N
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, cosine):
    """(n_links, component) by id, all pairs."""
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links[ids[i]] += 1
                    links[ids[j]] += 1
                    p, q = find(ids[i]), find(ids[j])
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("cell,piece", [(1024, 1024), (16, 8), (40, 1)])
def test_equals_brute_force(spark, monkeypatch, cell, piece):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "PIECE", piece)
    rng = np.random.default_rng(cell)
    rows = []
    for c in range(12):
        center = rng.normal(size=6)
        for _ in range(10):
            rows.append((len(rows), [float(np.float32(x)) for x in center + rng.normal(size=6) * 0.12], int(c % 2)))
    rows += [(900, rows[0][1], 0), (901, [2 * x for x in rows[0][1]], 0)]
    got = {r.id: (r.n_links, r.component) for r in N.range_join(frame(spark, rows), 0.98).collect()}
    assert got == brute(rows, 0.98)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [1.0, None], 1), (8, [1.0, 0.0, 0.0], 1), (9, [], 1), (10, [2.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [1.0, 0.0], 2),
    ]
    got = {r.id: (r.n_links, r.component) for r in N.range_join(frame(spark, rows), 0.98).collect()}
    assert got == {i: ((1, 1) if i in (1, 10) else (0, i)) for i in range(1, 13)}
    twice = N.range_join(frame(spark, [(1, [1.0], 1), (1, [1.0], 1), (None, [1.0], 1)]), 0.98).collect()
    assert sorted((r.id or 0, r.n_links, r.component or 0) for r in twice) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert N.range_join(frame(spark, []), 0.98).count() == 0


def test_assignment_replicates_every_partner():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, copy = N.assign(x, x[:20], 0.2)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2
    for i, j in zip(*np.nonzero(near), strict=True):
        assert home[i] == home[j] or copy[j, home[i]]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op4_embedding_near_dedup"](spark, SF).collect()}
    assert got == brute(rows, 0.98)


def test_labels_of_repeated_rows(spark):
    rows = [(k, [1.0, float(k)], k) for k in range(12) for _ in range(200)]
    got = {tuple(r) for r in N.range_join(frame(spark, rows), 0.98).collect()}
    assert got == {(k, 199, k) for k in range(12)}


def test_repeated_rows_are_dealt_to_all_pieces(spark):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("row"), F.lit(8).alias("pieces"))
    sizes = [r["count"] for r in rows.groupBy(N.own_piece()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 250
