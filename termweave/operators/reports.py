"""Run and trial reports (AG26, AG27, WN16)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_summary(log: DataFrame, modes: Mapping[str, str]) -> DataFrame:
    """AG26: best (by the metric's mode) and final value per run and metric; non-finite values ignored."""
    usable = log.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    smallest = [m for m, mode in modes.items() if mode == "min"]
    largest = [m for m, mode in modes.items() if mode == "max"]
    found = usable.groupBy("run_id", "metric").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max_by("value", "step").alias("final")
    )
    best = F.when(F.col("metric").isin(smallest), F.col("_lo")).when(F.col("metric").isin(largest), F.col("_hi"))
    return found.select("run_id", "metric", best.alias("best"), "final")


def trial_stop(trials: DataFrame, max_failures: int, target: int, baseline: int = 0) -> DataFrame:
    """AG27: failures above the baseline, completed trials, and whether to stop (1/0)."""
    counts = trials.agg(
        F.count_if(F.col("state") == "FAIL").alias("_f"), F.count_if(F.col("state") == "COMPLETE").alias("completed")
    ).withColumn("failed", F.greatest(F.lit(0), F.col("_f") - baseline))
    stop = (F.col("failed") >= max_failures) | (F.col("completed") >= target)
    return counts.select("failed", "completed", stop.cast("int").alias("stop"))


def best_epoch(log: DataFrame, metric: str, loss: str) -> DataFrame:
    """WN16: per run the first epoch with the largest metric, and the loss there.

    Epochs that lack either value are skipped. ``log`` has ``run_id, step, metric, value``.
    """
    epochs = log.filter(F.col("metric").isin(metric, loss)).groupBy("run_id", "step").agg(
        F.max(F.when(F.col("metric") == metric, F.col("value"))).alias("_m"),
        F.max(F.when(F.col("metric") == loss, F.col("value"))).alias("_l"),
    )
    both = epochs.filter(F.col("_m").isNotNull() & F.col("_l").isNotNull() & ~F.isnan("_m"))
    key = F.struct(F.col("_m"), -F.col("step"))
    best = both.groupBy("run_id").agg(F.max_by(F.struct("step", "_m", "_l"), key).alias("_b"))
    return best.select(
        "run_id", F.col("_b.step").alias("epoch"), F.col("_b._m").alias("metric_value"), F.col("_b._l").alias("loss")
    )
