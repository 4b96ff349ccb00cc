"""Quality classifier: interpolated modified Kneser-Ney over character trigrams of trusted text.

Trigrams of all trusted documents are counted exactly; the three orders of the model are tables of
Spark, joined on their own keys. A block of documents (some MB) lists its distinct trigrams, which are
joined with the model and come back to the block as log probabilities; a document's perplexity is the
mean over its characters. Nothing is broadcast and nothing grows in one task: what a block sends is
bounded by its own distinct trigrams.

A document's score is its mean negative log probability, drawn to the median of its language by
``prior_chars`` characters, so that a few characters alone prove nothing. The limit of a language is
the ``quantile`` of its trusted documents' held-out scores: ids are dealt into folds, and each fold is
scored by the model of the others, as documents that the model has not seen. Median and limit of a
language with c trusted documents are w of its own and 1 - w of those of all, with w = c^2 / (c^2 +
``pooled``^2); documents without language use those of all. Documents above the limit are rejected. If
one fold has all trusted text, scores are not held out.

Joins by language are salted, so a language that most documents have is spread over ``SALTS`` groups.

A null text is empty; empty texts have the median score and are kept. Without trusted text everything
is kept with a null perplexity limit. Repeated rows count and are scored one by one; a null id has no
label. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, block_of, buffers, from_blocks, save, table, to_blocks

BLOCK_BYTES = 3 << 20
#: Stands before the first character; no code point.
START = 0x110000
#: Folds of the trusted documents.
FOLDS = 3
#: Groups that the documents of a language are dealt to in joins.
SALTS = 64
_BITS = 21
_DENSE = 1 << 23


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with two START before each, and the length of each text."""
    _, raw = buffers(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lengths = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
    out = np.full(len(points) + 2 * len(lengths), START, np.uint32)
    out[np.arange(len(points)) + 2 * (np.repeat(np.arange(len(lengths)), lengths) + 1)] = points
    return out, lengths


def _fold(ids: pa.ChunkedArray, folds: int) -> np.ndarray:
    """The fold of each id."""
    numbers = np.asarray(pc.fill_null(ids, 0)).astype(np.int64).view(np.uint64)
    return (((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) * np.uint64(folds) >> np.uint64(24)).astype(np.int64)


class Trigrams:
    """The trigrams of a block's texts as small numbers, with the packed trigram of each number."""

    def __init__(self, texts: pa.Array):
        points, self.lengths = _characters(texts)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        if not len(self.doc):
            self.number, self.packed = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        letters = np.flatnonzero(np.bincount(points))
        n = len(letters)
        small = np.zeros(letters[-1] + 1, np.int64)
        small[letters] = np.arange(n)
        x = small[points]
        keys = ((x[:-2] * n + x[1:-1]) * n + x[2:])[points[2:] != START]
        if n**3 <= _DENSE:
            distinct = np.flatnonzero(np.bincount(keys, minlength=1))
            place = np.zeros(int(distinct[-1]) + 1, np.int32)
            place[distinct] = np.arange(len(distinct))
            self.number = place[keys]
        else:
            distinct, self.number = np.unique(keys, return_inverse=True)
        a, b, c = distinct // (n * n), distinct // n % n, distinct % n
        self.packed = (letters[a].astype(np.int64) << 2 * _BITS) | (letters[b].astype(np.int64) << _BITS) | letters[c]


def count_trigrams(blocks: DataFrame, trusted: DataFrame, folds: int) -> DataFrame:
    """(block, gram, n0, n1, ...): every trigram of a block, with its count in the trusted documents of each fold."""
    names = [f"n{k}" for k in range(folds)]

    def count(docs: pa.Table, known: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int32()), ("gram", pa.int64()), *((c, pa.int64()) for c in names)])
        if not docs.num_rows:
            return schema.empty_table()
        rows = from_blocks(docs.column("rows"))
        grams = Trigrams(rows.column(1).combine_chunks())
        sure = np.asarray(pc.fill_null(pc.is_in(rows.column(0), value_set=known.column("id").combine_chunks()), False))
        fold = _fold(rows.column(0), folds)
        inside = [(sure & (fold == k))[grams.doc] if len(grams.doc) else np.zeros(0, bool) for k in range(folds)]
        n = [np.bincount(grams.number[x], minlength=len(grams.packed)).astype(np.int64) for x in inside]
        block = np.full(len(grams.packed), docs.column("block")[0].as_py(), np.int32)
        return pa.table([pa.array(block), pa.array(grams.packed), *(pa.array(x) for x in n)], schema)

    return blocks.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(
        count, ", ".join(["block int", "gram long", *(f"{c} long" for c in names)])
    )


def _discounts(counts: DataFrame, n: str) -> list[float]:
    """Discounts for counts of one, two, and three or more, from the counts of counts."""
    of = counts.agg(*(F.sum((F.col(n) == k).cast("long")) for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(x or 0) for x in of)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    worth = [k + 1 - (k + 2) * y * b / a if a and b else (k + 1) / 2 for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
    return [min(max(w, 0.05), k + 0.95) for k, w in enumerate(worth)]


def _discount(n, d: list[float]):
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _level(counts: DataFrame, context, n: str, d: list[float]) -> DataFrame:
    """Total and left-over mass of each context."""
    c = F.col(n)
    rest = F.sum(_discount(c, d))
    return counts.groupBy(context.alias("context")).agg(F.sum(c).alias("total"), (rest / F.sum(c)).alias("rest"))


def kneser_ney(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, logp) of the trigrams ``asked`` under the model of ``counts`` (gram, n)."""
    low, mid = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1
    gram = F.col("gram")
    tails = counts.groupBy(gram.bitwiseAND(mid).alias("tail")).agg(F.count("*").alias("m"))
    ends = tails.groupBy(F.col("tail").bitwiseAND(low).alias("last")).agg(F.count("*").alias("k"))
    tails, ends = save(tails, "kn-tails"), save(ends, "kn-ends")
    d3, d2, d1 = _discounts(counts, "n"), _discounts(tails, "m"), _discounts(ends, "k")
    all_ends = ends.agg(F.sum("k").alias("s"), F.count("*").alias("v"), F.sum(_discount(F.col("k"), d1)).alias("r")).first()
    s, v, r = float(all_ends["s"] or 1), float(all_ends["v"] + 1), float(all_ends["r"] or 1)
    tops = _level(counts, F.shiftright(gram, _BITS), "n", d3).toDF("head", "total3", "rest3")
    mids = _level(tails, F.shiftright(F.col("tail"), _BITS), "m", d2).toDF("middle", "total2", "rest2")
    parts = asked.select(
        gram,
        F.shiftright(gram, _BITS).alias("head"),
        gram.bitwiseAND(mid).alias("tail"),
        F.shiftright(gram.bitwiseAND(mid), _BITS).alias("middle"),
        gram.bitwiseAND(low).alias("last"),
    )
    full = (
        parts.join(counts, "gram", "left").join(tops, "head", "left").join(tails, "tail", "left")
        .join(mids, "middle", "left").join(ends, "last", "left")
    )
    part = lambda n, total, d: F.coalesce(F.greatest(n - _discount(n, d), F.lit(0.0)) / total, F.lit(0.0))
    p1 = part(F.col("k"), F.lit(s), d1) + F.lit(r / s / v)
    full = full.withColumn("p1", p1)
    full = full.withColumn("p2", part(F.col("m"), F.col("total2"), d2) + F.coalesce("rest2", F.lit(1.0)) * F.col("p1"))
    p3 = part(F.col("n"), F.col("total3"), d3) + F.coalesce("rest3", F.lit(1.0)) * F.col("p2")
    return full.select("gram", F.log(p3).alias("logp"))


def score_blocks(blocks: DataFrame, known: DataFrame, folds: int) -> DataFrame:
    """(id, lang, n_chars, nll, held) of every document, from its block's trigrams with their logp.

    ``held`` is the sum under the model without the own fold; it is known for trusted documents.
    """

    def score(docs: pa.Table, model: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("nll", pa.float64()), ("held", pa.float64())])
        if not docs.num_rows:
            return schema.empty_table()
        rows = from_blocks(docs.column("rows"))
        grams = Trigrams(rows.column(1).combine_chunks())
        logp = np.zeros((folds + 1, len(grams.packed)))
        if len(grams.packed):
            given = model.column("gram").to_numpy()
            order = np.argsort(given)
            place = order[np.searchsorted(given[order], grams.packed)]
            for k, name in enumerate(("logp", *(f"logp{k}" for k in range(folds)))):
                logp[k] = model.column(name).to_numpy()[place]
        sums = np.zeros((2, rows.num_rows))
        if len(grams.doc):
            own = _fold(rows.column(0), folds)[grams.doc] + 1
            for k, worth in enumerate((logp[0][grams.number], logp[own, grams.number])):
                sums[k] = -np.bincount(grams.doc, weights=worth, minlength=rows.num_rows)
        return pa.table([rows.column(0), rows.column(2), pa.array(grams.lengths), pa.array(sums[0]), pa.array(sums[1])], schema)

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        score, "id long, lang string, n_chars long, nll double, held double"
    )


def by_language(rows: DataFrame, languages: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their language in ``languages``, which has one row each, as ``_name``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    named = languages.select(*(F.col(c).alias(f"_{c}") for c in languages.columns), salts)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    return rows.join(named, (F.col("lang") == F.col("_lang")) & (salt == F.col("_salt")), how)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = 0.99,
    prior_chars: int = 200,
    pooled: int = 20,
    folds: int = FOLDS,
) -> DataFrame:
    """Perplexity, limit and verdict of every row. ``labels``: (doc_id, quality), 1 is trusted."""
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    n = block_count(slim, "text", BLOCK_BYTES)
    blocks = to_blocks(slim, ["id", "text", "lang"], n, "id", "text")
    trusted = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id")).dropna().distinct()
    pairs = count_trigrams(blocks, trusted.select(block_of(F.col("id"), n).alias("block"), "id"), folds)
    pairs = save(pairs, "kn-pairs")
    each = [f"n{k}" for k in range(folds)]
    grams = pairs.groupBy("gram").agg(*(F.sum(c).alias(c) for c in each)).withColumn("n", F.expr(" + ".join(each)))
    grams = save(grams, "kn-grams")
    fitted = grams.agg(*(F.max(F.col("n") - F.col(c)) for c in each)).first()
    known = kneser_ney(grams.filter("n > 0").select("gram", "n"), grams.select("gram"))
    for k, c in enumerate(each):
        others = grams.select("gram", (F.col("n") - F.col(c)).alias("n")).filter("n > 0")
        model = kneser_ney(others, grams.filter(F.col(c) > 0).select("gram"))
        known = known.join(model.withColumnRenamed("logp", f"logp{k}"), "gram", "left")
    known = save(known, "kn-model")
    scores = save(score_blocks(blocks, pairs.select("block", "gram").join(known, "gram"), folds), "kn-scores")
    mean = F.when(F.col("n_chars") > 0, F.col("nll") / F.col("n_chars"))
    held = F.col("held") if all(fitted) else F.col("nll")
    sure = scores.filter("n_chars > 0").join(trusted, "id", "left_semi")
    sure = save(sure.select("lang", "n_chars", held.alias("held"), mean.alias("mean")), "kn-trusted")
    median = F.percentile_approx("mean", 0.5, 10_000).alias("mid")
    # The median of the scores that are drawn to it, and the quantile of the held-out ones as they are drawn.
    draw = lambda nll, mid: (nll + prior_chars * mid) / (F.col("n_chars") + prior_chars)
    high = lambda mid: F.percentile_approx(draw(F.col("held"), mid), quantile, 10_000).alias("high")
    overall = sure.agg(median).first()["mid"]
    if overall is None:
        return scores.select(
            F.col("id").alias(id_col), "lang", "n_chars", F.exp(mean).alias("perplexity"),
            F.lit(None).cast("double").alias("most_perplexity"), F.lit(True).alias("kept"),
        )
    most = sure.agg(high(F.lit(overall))).first()["high"]
    middle = sure.filter("lang IS NOT NULL").groupBy("lang").agg(median, F.count("*").cast("double").alias("c"))
    weight = F.col("c") * F.col("c") / (F.col("c") * F.col("c") + float(pooled) ** 2)
    middle = middle.select("lang", weight.alias("w"), (weight * F.col("mid") + (1 - weight) * overall).alias("mid"))
    middle = save(middle, "kn-languages")
    limits = by_language(sure, middle).groupBy("_lang", "_w", "_mid").agg(high(F.col("_mid")))
    limits = limits.select(F.col("_lang").alias("lang"), F.col("_mid").alias("mid"), (F.col("_w") * F.col("high") + (1 - F.col("_w")) * most).alias("high"))
    both = by_language(scores, save(limits, "kn-limits"), "left")
    limit = F.coalesce("_high", F.lit(most))
    drawn = draw(F.col("nll"), F.coalesce("_mid", F.lit(overall)))
    return both.select(
        F.col("id").alias(id_col),
        "lang",
        "n_chars",
        F.exp(mean).alias("perplexity"),
        F.exp(limit).alias("most_perplexity"),
        (drawn <= limit).alias("kept"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
