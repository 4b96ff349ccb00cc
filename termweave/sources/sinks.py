"""Writers (SC15-SC22). All write in parallel through Spark; paths must be shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import _exists


def write_splits(splits: DataFrame, path: str) -> None:
    """SC15: CSV of ``entry_id`` below one folder per split."""
    splits.select("entry_id", "split").write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def manifest_records(
    records: DataFrame, splits: DataFrame, wanted: list[str], on_empty: str = "empty", keys: Sequence[str] = ()
) -> DataFrame:
    """SC16 rows: records with their split, by itself within each of ``keys``. With ``on_empty="all"`` a
    wanted split without records gets all of them (this leaks training rows into it, hence not the default)."""
    keys = list(keys)
    placed = records.join(splits.select(*keys, "entry_id", "split"), [*keys, "entry_id"])
    if on_empty == "empty":
        return placed
    if on_empty != "all":
        raise ValueError(f"unknown policy {on_empty!r}")
    names = F.explode(F.array(*map(F.lit, wanted))).alias("split")
    groups = records.select(*keys, names).distinct()
    missing = groups.join(placed.select(*keys, "split").distinct(), [*keys, "split"], "left_anti")
    # at most the wanted names in a group: a record carries them as one list
    lost = missing.groupBy(*keys).agg(F.collect_list("split").alias("_lost"))
    held = records.join(lost, keys) if keys else records.withColumn("_lost", lost.select("_lost").scalar())
    every = held.withColumn("split", F.explode("_lost"))
    return placed.unionByName(every.select(*placed.columns))


def write_manifest(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SC16: one record per row below split/aspect folders."""
    df.write.mode("overwrite").partitionBy("split", "aspect").format(fmt).save(path)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """SC17: ``entry_id, term, score_text`` as tab-separated lines."""
    df.select("entry_id", "term", "score_text").write.mode(mode).option("sep", "\t").csv(path)


def metrics_table(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """SC18: one row per aspect, one column per metric name (sorted)."""
    grouped = metrics.groupBy("aspect")
    wide = grouped.pivot("metric", sorted(names)) if names else grouped.pivot("metric")
    return wide.agg(F.first("value"))


def write_metrics(metrics: DataFrame, path: str, names: list[str] | None = None) -> None:
    """SC18: the wide table as tab-separated text with header."""
    metrics_table(metrics, names).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def fasta_records(seqs: DataFrame) -> DataFrame:
    """FASTA text, one record per row."""
    return seqs.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence")).alias("value"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Sequences as FASTA text files."""
    fasta_records(seqs).write.mode("overwrite").text(path)


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Annotations as tab-separated text, every file with the header line."""
    named = annotations.select(F.col("entry_id").alias("EntryID"), "term", "aspect")
    named.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_subset(seqs: DataFrame, annotations: DataFrame, ids: DataFrame, path: str) -> None:
    """SC19: sequences and annotations of the selected entries, in their input formats."""
    wanted = ids.select("entry_id").distinct()
    write_fasta(seqs.join(wanted, "entry_id", "left_semi"), f"{path}/sequences")
    write_annotations(annotations.join(wanted, "entry_id", "left_semi"), f"{path}/annotations")


def write_selection(selection: DataFrame, path: str) -> None:
    """SC20: entry_id, tax_id, go_freq_score, similarity_score below aspect and set folders."""
    columns = ["entry_id", "tax_id", "go_freq_score", "similarity_score", "aspect", "set_name"]
    selection.select(*columns).write.mode("overwrite").partitionBy("aspect", "set_name").option("header", True).csv(path)


def term_lists(annotations: DataFrame) -> DataFrame:
    """SC21 rows: entry_id and its terms as a JSON list (repeats kept, sorted)."""
    counted = annotations.groupBy("entry_id", "term").agg(F.count(F.lit(1)).cast("int").alias("n"))
    packed = counted.groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("t"))
    terms = F.flatten(F.transform("t", lambda x: F.array_repeat(x["term"], x["n"])))
    return packed.select("entry_id", F.to_json(terms).alias("go_terms"))


def write_term_lists(annotations: DataFrame, path: str) -> None:
    """SC21: the list-valued CSV that :func:`explode_term_cells` reads back."""
    term_lists(annotations).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def batch_plan_path(manifest: str, size: int, folder: str | None = None, split: str | None = None) -> str:
    """SC22: where the batch plan of a manifest lies: beside it under its own name, or in ``folder`` under
    the split's name; relative folders start at the manifest's."""
    parent, _, name = manifest.rpartition("/")
    if folder is None:
        return f"{parent}/{name.rsplit('.', 1)[0]}_batches_bs{size}" if parent else f"{name.rsplit('.', 1)[0]}_batches_bs{size}"
    root = folder if folder.startswith("/") or ":/" in folder or not parent else f"{parent}/{folder}"
    return f"{root}/{split + '_' if split else ''}batches_bs{size}"


def plan_fingerprint(entries: DataFrame, size: int, drop_last: bool = False) -> str:
    """What a batch plan is made of: its size and a mark of all ids and lengths, in whatever order."""
    mark = F.xxhash64("entry_id", "length")
    found = entries.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first()
    return "|".join(str(x) for x in (size, drop_last, *found))


def write_batches(batches: DataFrame, path: str, fingerprint: str | None = None) -> None:
    """SC22: batch plan as Parquet; the fingerprint is a constant column, so it is committed with the plan."""
    columns = batches.select("batch_id", "pos", "entry_id", F.lit(fingerprint).cast("string").alias("_plan"))
    columns.write.mode("overwrite").parquet(path)


def read_batches(
    spark: SparkSession,
    path: str,
    build=None,
    size: int | None = None,
    entries: DataFrame | None = None,
    drop_last: bool = False,
) -> DataFrame:
    """SC22: a finished batch plan is reused; otherwise ``build()`` is written first.

    A plan counts as finished when its writer has committed it. With ``entries`` (``entry_id, length``) and
    ``size`` it must have been made of just these; a plan of another manifest, other lengths or another
    size is made anew. With ``size`` alone no batch may be larger. Without ``build`` an unusable plan is an error.
    """
    if entries is not None and size is None:
        raise ValueError("the entries of a plan are compared together with its size")
    wanted = plan_fingerprint(entries, size, drop_last) if entries is not None else None
    if _exists(spark, f"{path}/_SUCCESS"):
        plan = spark.read.parquet(path)
        if wanted is not None:
            made = plan.select("_plan").first() if "_plan" in plan.columns else None
            usable = made is not None and made[0] == wanted
        else:
            widest = plan.agg(F.max("pos")).first()[0] if size is not None else None
            usable = widest is None or widest < size
        if usable:
            return plan.drop("_plan")
    if build is None:
        raise FileNotFoundError(f"no usable batch plan in {path}")
    write_batches(build(), path, wanted)
    return spark.read.parquet(path).drop("_plan")
