"""AG11-AG15, AG20-AG22, AG26-AG28, PF11, PF14, WN16, SO02, UD04, SC18."""

from pyspark.sql import functions as F

from ..functions import arrays as ax
from ..operators import inference, metrics, ranking, reports
from ..sources.sinks import metrics_table
from .registry import Inputs, query

TAUS = metrics.DEFAULT_THRESHOLDS
_TAU = "SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS tau"
_NE = "(SELECT count(DISTINCT l_orderkey) FROM lineitem)"


def _curve_sql(weight: str, source: str) -> dict[str, str]:
    return {
        "taus": _TAU,
        "sw": f"SELECT s.*, CAST({weight} AS DOUBLE) AS w FROM {source}",
        "truth": "SELECT entry_id, sum(w * label) AS tr FROM sw GROUP BY 1",
        "e": "SELECT tau, sw.entry_id, sum(w) AS pr, sum(w * label) AS hit, any_value(tr) AS tr FROM sw JOIN truth ON truth.entry_id = sw.entry_id JOIN taus ON score >= tau GROUP BY 1, 2",
        "c": f"SELECT t.tau, count(*) FILTER (pr > 0) AS cov, sum(hit / pr) FILTER (pr > 0) / nullif(count(*) FILTER (pr > 0), 0) AS precision, coalesce(sum(hit / tr) FILTER (tr > 0), 0) / {_NE} AS recall FROM taus t LEFT JOIN e ON e.tau = t.tau GROUP BY 1",
        "curve": "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f FROM c",
    }


_PLAIN = _curve_sql("1", "scored s")
_IA = _curve_sql("coalesce(ia.ia, 0)", "scored s LEFT JOIN ia ON ia.term = s.term")
_ROUND = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f, 9) AS f"
_BEST = "SELECT round(f, 9) AS fmax, round(precision, 9) AS precision, round(recall, 9) AS recall, tau FROM curve WHERE f IS NOT NULL ORDER BY f DESC, tau LIMIT 1"


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 9))
    return df


def _curve(t: Inputs, weights=None):
    return metrics.pr_curve(t.scored(), TAUS, t.scored_entries(), weights)


@query("ag11_pr_curve", "scored", f"SELECT tau, cov, {_ROUND} FROM curve", **_PLAIN)
def _(t):
    return _rounded(_curve(t), "precision", "recall", "f")


@query("ag12_fmax", "scored", _BEST, **_PLAIN)
def _(t):
    return _rounded(metrics.fmax(_curve(t)), "fmax", "precision", "recall")


@query("ag13_weighted_pr_curve", "scored ia", f"SELECT tau, cov, {_ROUND} FROM curve", **_IA)
def _(t):
    return _rounded(_curve(t, t.ia()), "precision", "recall", "f")


@query("ag13_weighted_fmax", "scored ia", _BEST, **_IA)
def _(t):
    return _rounded(metrics.fmax(_curve(t, t.ia())), "fmax", "precision", "recall")


_AP = {
    "cells": f"SELECT term, score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY 1, 2 UNION ALL SELECT term, 0.0, {_NE} - count(*), 0 FROM scored GROUP BY term",
    "steps": "SELECT term, score, sum(n) AS n, sum(pos) AS pos FROM cells GROUP BY 1, 2",
    "cum": "SELECT term, n, pos, score, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY term) AS p, sum(n) OVER (PARTITION BY term) AS nn FROM steps WINDOW w AS (PARTITION BY term ORDER BY score DESC)",
    "ap": "SELECT term, sum(CAST(pos AS DOUBLE) / p * (CAST(cp AS DOUBLE) / cn)) AS ap FROM cum WHERE p > 0 GROUP BY term",
    "auc": "SELECT term, sum(pos * ((nn - p) - (cn - cp) + 0.5 * (n - pos))) / (any_value(p) * any_value(nn - p)) AS auc FROM cum WHERE p > 0 AND nn > p GROUP BY term",
}


@query("ag14_average_precision", "scored", "SELECT term, round(ap, 9) AS ap FROM ap", **_AP)
def _(t):
    return _rounded(metrics.average_precision(t.scored(), t.scored_entries()), "ap")


@query("ag14_macro_ap", "scored", "SELECT round(avg(ap), 9) AS ap FROM ap", **_AP)
def _(t):
    return _rounded(metrics.macro_ap(t.scored(), t.scored_entries()), "ap")


@query("ag15_roc_auc", "scored", "SELECT term, round(auc, 9) AS auc FROM auc", **_AP)
def _(t):
    return _rounded(metrics.roc_auc(t.scored(), t.scored_entries()), "auc")


@query("ag15_macro_auc", "scored", "SELECT round(avg(auc), 9) AS auc, count(*) AS n_terms FROM auc", **_AP)
def _(t):
    return _rounded(metrics.macro_auc(t.scored(), t.scored_entries()), "auc")


@query("ud04_ap_udaf", "scored", "SELECT term, round(ap, 9) AS ap FROM ap", **_AP)
def _(t):
    return _rounded(inference.ap_udaf(t.scored(), t.scored_entries()), "ap")


_LOGIT = "SELECT entry_id, term, label, 8 * score - 4 AS x, CAST(label AS DOUBLE) AS y, 1.0 / (1.0 + exp(-(8 * score - 4))) AS p FROM scored"


def _logits(t: Inputs):
    return t.scored().select("entry_id", "term", (8 * F.col("score") - 4).alias("x"), F.col("label").cast("double").alias("y"))


@query("ag20_bce", "scored", "SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS loss FROM q", q=_LOGIT)
def _(t):
    return _rounded(metrics.mean_loss(_logits(t), ax.bce(F.col("x"), F.col("y"))), "loss")


@query("ag20_bce_weighted", "scored", "SELECT term, round(avg(-((1 + term) * y * ln(p) + (1 - y) * ln(1 - p))), 9) AS loss FROM q GROUP BY term", q=_LOGIT)
def _(t):
    return _rounded(metrics.mean_loss(_logits(t), ax.bce(F.col("x"), F.col("y"), F.col("term") + 1.0), ["term"]), "loss")


@query("ag21_focal", "scored", """
SELECT round(avg((0.25 * y + 0.75 * (1 - y)) * pow(1 - (y * p + (1 - y) * (1 - p)), 2.0) * -ln(y * p + (1 - y) * (1 - p))), 9) AS loss FROM q""", q=_LOGIT)
def _(t):
    return _rounded(metrics.mean_loss(_logits(t), ax.focal(F.col("x"), F.col("y"))), "loss")


@query("ag22_asymmetric", "scored", """
SELECT round(avg(-(y * ln(p) * pow(1 - p, 1.0) + (1 - y) * ln(greatest(1 - least(p + 0.025, 1.0), 1e-8)) * pow(p, 4.0))), 9) AS loss FROM q""", q=_LOGIT)
def _(t):
    return _rounded(metrics.mean_loss(_logits(t), ax.asymmetric(F.col("x"), F.col("y"), gp=1.0)), "loss")


@query("ag28_mean_loss", "run_metrics", "SELECT run_id, metric, round(avg(value), 6) AS loss FROM run_metrics GROUP BY 1, 2")
def _(t):
    return metrics.mean_loss(t.run_metrics(), F.col("value"), ["run_id", "metric"]).withColumn("loss", F.round("loss", 6))


@query("pf11_finite", "", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount / l_tax, 9) END AS value FROM lineitem""")
def _(t):
    ratio = F.try_divide("l_discount", "l_tax")
    raw = F.when(F.col("l_tax") > 0, ratio).when(F.col("l_discount") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.round(ax.finite(raw), 9).alias("value"))


@query("pf11_finite_array", "", """
SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x < 0 THEN 0 ELSE x END)), 6) AS total FROM embeddings""")
def _(t):
    raw = F.transform("embedding", lambda x: F.when(x < 0, F.lit(float("-inf"))).otherwise(x.cast("double")))
    total = F.aggregate(ax.finite_array(raw), F.lit(0.0), lambda a, x: a + x)
    return t.table("embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query("pf14_sigmoid", "scored", "SELECT entry_id, term, round(p, 9) AS prob FROM q", q=_LOGIT)
def _(t):
    return _logits(t).select("entry_id", "term", F.round(ax.sigmoid(F.col("x")), 9).alias("prob"))


MODES = {"error": "min", "view": "max", "click": "max", "purchase": "max", "signup": "min"}


@query("ag26_metric_summary", "run_metrics", """
SELECT run_id, metric, CASE WHEN metric IN ('error', 'signup') THEN min(value) ELSE max(value) END AS best, arg_max(value, step) AS final FROM run_metrics GROUP BY 1, 2""")
def _(t):
    return reports.metric_summary(t.run_metrics(), MODES)


@query("ag27_trial_stop", "trials", """
SELECT failed, completed, CASE WHEN failed >= 100 OR completed >= 1000000 THEN 1 ELSE 0 END AS stop FROM
(SELECT greatest(0, count(*) FILTER (state = 'FAIL') - 5) AS failed, count(*) FILTER (state = 'COMPLETE') AS completed FROM trials)""")
def _(t):
    return reports.trial_stop(t.trials(), max_failures=100, target=1000000, baseline=5)


_EPOCHS = "SELECT user_id AS run_id, event_id // 500 AS step, event_type AS metric, max(value) AS value FROM events GROUP BY 1, 2, 3"


def _epochs(t: Inputs):
    return t.table("events").groupBy(
        F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 500).alias("step"), F.col("event_type").alias("metric")
    ).agg(F.max("value").alias("value"))


@query("wn16_best_epoch", "", """
SELECT run_id, step AS epoch, m AS metric_value, l AS loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY m DESC, step) AS r FROM
(SELECT a.run_id, a.step, a.value AS m, b.value AS l FROM ep a JOIN ep b ON b.run_id = a.run_id AND b.step = a.step WHERE a.metric = 'purchase' AND b.metric = 'error')) WHERE r = 1
""", ep=_EPOCHS)
def _(t):
    return reports.best_epoch(_epochs(t), "purchase", "error")


@query("so02_top_trials", "trials", """
SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, trial_id) AS rank, trial_id, value FROM trials WHERE state = 'COMPLETE' ORDER BY 1 LIMIT 20""")
def _(t):
    return ranking.top_trials(t.trials(), 20)


@query("sc18_metrics_table", "run_metrics", """
SELECT CAST(run_id AS VARCHAR) AS aspect, max(value) FILTER (metric = 'click') AS click, max(value) FILTER (metric = 'error') AS error,
max(value) FILTER (metric = 'purchase') AS purchase, max(value) FILTER (metric = 'signup') AS signup, max(value) FILTER (metric = 'view') AS view FROM run_metrics GROUP BY run_id""")
def _(t):
    best = t.run_metrics().groupBy(F.col("run_id").cast("string").alias("aspect"), "metric").agg(F.max("value").alias("value"))
    return metrics_table(best, list(MODES))
