"""Evaluation metrics and losses over long (entry, term, score, label) rows (AG11-AG15, AG20-AG22, AG28).

An absent row means score 0 and label 0; the number of entries enters as ``n_entries``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running_totals, same

# The threshold grid of the prediction report.
DEFAULT_THRESHOLDS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def pr_curve(
    scored: DataFrame,
    thresholds: Sequence[float],
    n_entries: int,
    weights: DataFrame | None = None,
    keys: Sequence[str] = (),
    n_terms: int | None = None,
) -> DataFrame:
    """AG11/AG13: entry-centric precision, recall and F at thresholds -> keys, tau, cov, precision, recall, f.

    Predicted means score >= tau. Precision averages over the entries with a prediction, recall over
    all ``n_entries``; F is their harmonic mean (null when undefined). With ``weights`` (term, ia)
    sums of weights replace counts. A threshold <= 0 predicts every term of the vocabulary and needs
    ``n_terms`` (or ``weights``), because absent rows are not stored.

    Rows are reduced to (entry, threshold step) sums before any shuffle carries them: a score is
    replaced by the number of thresholds it reaches, so an entry contributes at most one row per
    threshold however many terms it has.
    """
    taus = sorted({float(t) for t in thresholds})
    keys = list(keys)
    positive_taus = [t for t in taus if t > 0]
    rows = scored
    if weights is None:
        rows = rows.withColumn("_w", F.lit(1.0))
    else:
        rows = rows.join(weights.select("term", F.col("ia").cast("double").alias("_w")), "term", "left").fillna(0.0, ["_w"])
    step = F.lit(0)
    for t in positive_taus:
        step = step + F.when(F.col("score") >= t, 1).otherwise(0)
    entry = [*keys, "entry_id"]
    reduced = rows.withColumn("_s", step).groupBy(*entry, "_s").agg(
        F.sum("_w").alias("_pred"), F.sum(F.col("_w") * F.col("label")).alias("_hit")
    )
    # At most len(thresholds) + 1 rows per entry from here on.
    down = Window.partitionBy(*entry).orderBy(F.col("_s").desc())
    whole = Window.partitionBy(*entry)
    steps = reduced.select(
        *entry,
        "_s",
        F.sum("_pred").over(down).alias("_pred"),
        F.sum("_hit").over(down).alias("_hit"),
        F.sum("_hit").over(whole).alias("_true"),
        F.coalesce(F.lead("_s").over(down), F.lit(0)).alias("_below"),
    )
    per_tau = steps.filter(F.col("_s") > 0).select(
        *keys, F.explode(F.sequence(F.col("_below") + 1, F.col("_s"))).alias("_i"), "_pred", "_hit", "_true"
    )
    covered = (F.col("_pred") > 0).cast("int")
    sums = per_tau.groupBy(*keys, "_i").agg(
        F.sum(covered).cast("bigint").alias("cov"),
        F.sum(F.when(F.col("_pred") > 0, F.col("_hit") / F.col("_pred"))).alias("_p"),
        F.sum(F.when(F.col("_true") > 0, F.col("_hit") / F.col("_true"))).alias("_r"),
    )
    grid_values = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(t).alias("tau")) for i, t in enumerate(positive_taus)])
    groups = scored.select(*keys).distinct() if keys else scored.sparkSession.range(1).select()
    grid = groups.select(*keys, F.inline(grid_values)) if positive_taus else None
    parts = []
    if grid is not None:
        parts.append(grid.join(sums, [*keys, "_i"], "left").select(*keys, "tau", "cov", "_p", "_r"))
    if len(positive_taus) < len(taus):
        if weights is None and n_terms is None:
            raise ValueError("a threshold <= 0 needs n_terms")
        total = weights.agg(F.sum(F.col("ia").cast("double"))).scalar() if weights is not None else F.lit(float(n_terms))
        truth = rows.groupBy(*entry).agg(F.sum(F.col("_w") * F.col("label")).alias("_true"))
        every = truth.groupBy(*keys).agg(
            F.lit(n_entries).cast("bigint").alias("cov"),
            (F.sum("_true") / total).alias("_p"),
            F.sum((F.col("_true") > 0).cast("double")).alias("_r"),
        )
        low = F.array(*[F.lit(t) for t in taus if t <= 0])
        parts.append(every.select(*keys, F.explode(low).alias("tau"), "cov", "_p", "_r"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    precision = F.when(F.coalesce("cov", F.lit(0)) > 0, F.coalesce("_p", F.lit(0.0)) / F.col("cov"))
    out = out.select(
        *keys,
        "tau",
        F.coalesce("cov", F.lit(0)).cast("bigint").alias("cov"),
        precision.alias("precision"),
        (F.coalesce("_r", F.lit(0.0)) / F.lit(float(n_entries))).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both))


def fmax(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AG12: first threshold with the largest F -> keys, fmax, precision, recall, tau.

    Undefined F values are ignored; when all are, the measures are 0 at the first threshold.
    """
    best = F.max_by(F.struct("f", "precision", "recall", "tau"), F.when(F.col("f").isNotNull(), F.struct("f", -F.col("tau"))))
    out = curve.groupBy(*keys).agg(best.alias("_b"), F.min("tau").alias("_first"))
    zero = F.lit(0.0)
    return out.select(
        *keys,
        F.coalesce("_b.f", zero).alias("fmax"),
        F.coalesce("_b.precision", zero).alias("precision"),
        F.coalesce("_b.recall", zero).alias("recall"),
        F.coalesce("_b.tau", "_first").alias("tau"),
    )


def term_ranking(scored: DataFrame, n_entries: int, keys: Sequence[str] = ()) -> DataFrame:
    """AG14/AG15 per term with a positive -> keys, term, ap, auc (NULL unless the term has both classes).

    Rows become steps of equal score before anything is ordered, and one descending pass over the
    steps serves both measures. A missing score is 0, and entries without a row join the step of
    score 0. Average precision is step-wise; the area under the ROC curve counts a pair of equal
    scores as one half.
    """
    group = [*keys, "term"]
    score = F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
    steps = scored.select(*group, score, "label").groupBy(*group, "score").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("label").cast("bigint").alias("_pos")
    )
    totals = steps.groupBy(*group).agg(F.sum("_n").alias("_rows"), F.sum("_pos").alias("_p")).filter("_p > 0")
    run = same(running_totals(steps, group, "score", {"_n": "_cum", "_pos": "_cum_pos"}), totals, group)
    absent = F.lit(n_entries) - F.col("_rows")
    late = F.when(F.col("score") <= 0, absent).otherwise(0)
    seen = F.col("_cum") + late
    gain = F.col("_pos") / F.col("_p") * (F.col("_cum_pos") / seen)
    negatives = F.lit(n_entries) - F.col("_p")
    own = F.col("_n") - F.col("_pos") + late
    below = negatives - (seen - F.col("_cum_pos"))
    area = F.when(negatives > 0, F.col("_pos") * (below + 0.5 * own) / (F.col("_p") * negatives))
    return run.groupBy(*group).agg(F.sum(gain).alias("ap"), F.sum(area).alias("auc"))


def average_precision(scored: DataFrame, n_entries: int, keys: Sequence[str] = ()) -> DataFrame:
    """AG14: step-wise average precision per term with at least one positive; score ties are one step."""
    return term_ranking(scored, n_entries, keys).select(*keys, "term", "ap")


def macro_ap(scored: DataFrame, n_entries: int, keys: Sequence[str] = ()) -> DataFrame:
    """AG14: mean average precision over terms, 0 when no term has a positive."""
    return average_precision(scored, n_entries, keys).groupBy(*keys).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("ap"))


def roc_auc(scored: DataFrame, n_entries: int, keys: Sequence[str] = ()) -> DataFrame:
    """AG15: area under the ROC curve per term with both classes, ties at one half."""
    return term_ranking(scored, n_entries, keys).filter("auc IS NOT NULL").select(*keys, "term", "auc")


def macro_auc(scored: DataFrame, n_entries: int, keys: Sequence[str] = ()) -> DataFrame:
    """AG15: mean AUC over the two-class terms, with how many there were."""
    return roc_auc(scored, n_entries, keys).groupBy(*keys).agg(
        F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n_terms")
    )


def mean_loss(df: DataFrame, expr: Column, by: Sequence[str] = ()) -> DataFrame:
    """AG28: mean of a loss expression, per group when asked."""
    return df.groupBy(*by).agg(F.avg(expr).alias("loss"))
