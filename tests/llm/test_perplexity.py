import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from termweave.llm import perplexity as P
from termweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(trusted, asked):
    """Interpolated modified Kneser-Ney over characters, straight from its definition."""
    three = Counter()
    for t in trusted:
        x = ["<", "<", *t]
        three.update(zip(x, x[1:], x[2:], strict=False))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def discounts(counts):
        n = Counter(counts.values())
        if not n[1] + n[2]:
            return [0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k / 2
            out.append(min(max(d, 0.05), k - 0.05))
        return out

    def level(counts):
        d = discounts(counts)
        total, rest = defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            rest[g[:-1]] += d[min(n, 3) - 1]
        return lambda g, lower: (
            (max(counts[g] - d[min(counts[g], 3) - 1], 0) / total[g[:-1]] if counts[g] else 0)
            + rest[g[:-1]] / total[g[:-1]] * lower
            if g[:-1] in total
            else lower
        )

    d1, s = discounts(one), sum(one.values())
    r = sum(d1[min(n, 3) - 1] for n in one.values())
    p3, p2 = level(three), level(two)

    def logp(text):
        total, x = 0.0, ["<", "<", *text]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            n = one[c]
            p = (max(n - d1[min(n, 3) - 1], 0) / s if n else 0) + r / s / (len(one) + 1)
            total += math.log(p3((a, b, c), p2((b, c), p)))
        return total

    return [logp(t) for t in asked]


def test_perplexity_equals_brute_force(spark, docs, prose):
    rows = [(i, prose(i, 60)) for i in range(12)] + [(20, "ÄÖ ß 日本語 ###"), (21, ""), (22, None), (23, "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in P.classify(docs(rows), labels).collect()}
    texts = [t or "" for _, t in rows]
    for (i, _), t, want in zip(rows, texts, brute(texts[:8], texts), strict=True):
        assert got[i].n_chars == len(t)
        if t:
            assert math.log(got[i].perplexity) == pytest.approx(-want / len(t), rel=1e-9)
    assert got[21].kept and got[22].kept


def test_junk_goes_and_prose_stays(spark, docs, prose):
    rows = [(i, prose(i, 80)) for i in range(60)] + [(100 + i, " ".join(w.upper() + "###" for w in prose(i, 80).split())) for i in range(5)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in P.classify(docs(rows), labels).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(5))


def test_edges(spark, docs, prose):
    rows = [(1, prose(1, 50), None), (1, prose(1, 50), None), (None, prose(2, 50), "fr"), (3, prose(3, 30_000))]
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert P.classify(docs(rows), labels).count() == 4
    none = P.classify(docs(rows), labels.filter("quality = 7")).collect()
    assert len(none) == 4 and all(r.kept and r.most_perplexity is None for r in none)
    assert P.classify(docs(rows).limit(0), labels).count() == 0


def test_wide_alphabet_takes_the_sorted_path(monkeypatch):
    import pyarrow as pa

    text = pa.array(["abcab", "", "ab日本cab"])
    small = P.Trigrams(text)
    monkeypatch.setattr(P, "_DENSE", 1)
    large = P.Trigrams(text)
    assert (small.packed == large.packed).all() and (small.number == large.number).all()


def test_query_separates_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op2_quality_classifier"](spark, SF).join(labels, "doc_id")
    rate = {r.quality: r.rate for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.5


def test_limit_is_a_quantile_of_held_out_scores(spark, docs, prose):
    """Junk between that quantile and a few times its distance from the median goes, also when it is short."""
    rows = [(i, prose(i, 80)) for i in range(60)]
    some = lambda t, n: " ".join(w.upper() if k % n == 0 else w for k, w in enumerate(t.split()))
    rows += [(100 + i, some(prose(100 + i, 80), 12)) for i in range(10)] + [(200 + i, prose(200 + i, 5).upper()) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in P.classify(docs(rows), labels).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in kept if i >= 100)


def test_query_separates_most_labels(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op2_quality_classifier"](spark, sf).join(labels, "doc_id")
    rate = {r.quality: r.rate for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.05


def test_salted_join_by_language(spark):
    rows = spark.createDataFrame([("de", k) for k in range(300)] + [("fr", 1), ("fr", 1), ("xx", 2), (None, 3)], "lang string, k long")
    languages = spark.createDataFrame([("de", 1.0), ("fr", 2.0), ("it", 3.0)], "lang string, mid double")
    got = P.by_language(rows, languages, "left").groupBy("lang", "_mid").count().collect()
    assert sorted((r["lang"] or "", r["_mid"], r["count"]) for r in got) == [("", None, 1), ("de", 1.0, 300), ("fr", 2.0, 2), ("xx", None, 1)]
