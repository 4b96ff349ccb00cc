"""FASTA scan (SC01-SC04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import deduplicate


def file_order() -> Column:
    """Position of a text row over all input files: path, split offset, order inside the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def entry_id(header: Column, rule: str) -> Column:
    """Entry id of a header line under the ``strict``, ``flexible`` or ``loose`` rule."""
    tokens = F.split(header, r"\|")
    word = F.get(F.split(F.trim(header), r"\s+"), F.lit(0))
    if rule == "strict":
        bad = F.raise_error(F.concat(F.lit("unexpected FASTA header: "), header))
        return F.when(F.size(tokens) >= 3, F.trim(F.get(tokens, F.lit(1)))).otherwise(bad)
    if rule == "flexible":
        second = F.trim(F.get(tokens, F.lit(1)))
        return F.when((F.size(tokens) >= 3) & (second != ""), second).otherwise(word)
    if rule == "loose":
        parts = F.filter(F.split(word, r"\|"), lambda t: t != "")
        return F.when(F.contains(word, F.lit("|")) & (F.size(parts) >= 2), F.get(parts, F.lit(1))).otherwise(word)
    raise ValueError(f"unknown header rule {rule!r}")


def read_fasta(
    spark: SparkSession, path: str, header: str = "strict", duplicates: str | None = "last", with_order: bool = False
) -> DataFrame:
    """SC01-SC04: FASTA files to ``entry_id, header, sequence`` (``ord`` with ``with_order``).

    The record separator is the line break before ``>``, so files split over tasks at records.
    ``duplicates`` is last, first, error, or None to keep every record.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", file_order().alias("ord"))
    record = F.regexp_replace("value", r"^\s*>", "")
    rows = rows.select("ord", F.regexp_replace(record, "\r", "").alias("_r")).filter(F.trim("_r") != "")
    lines = F.split("_r", "\n", 2)
    head = F.trim(F.get(lines, F.lit(0)))
    body = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", "")
    out = rows.select(entry_id(head, header).alias("entry_id"), head.alias("header"), body.alias("sequence"), "ord")
    if duplicates:
        out = deduplicate(out, F.col("ord"), duplicates)
    return out if with_order else out.drop("ord")
