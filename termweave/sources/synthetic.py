"""Synthetic entries (SC24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RESIDUES


def synthetic_entries(
    spark: SparkSession, n: int | None = None, n_terms: int = 50, min_len: int = 20, max_len: int = 60, seed: int = 0,
    ids: DataFrame | None = None,
) -> DataFrame:
    """SC24: entries with a random sequence of bounded length and 1-3 distinct terms.

    Every value is a hash of (id, seed, position), so the table does not depend on partitioning; one
    hash gives four letters.
    ``ids`` (column ``id``) replaces the range of ``n`` ids.
    """
    base = spark.range(n) if ids is None else ids.select("id")

    def digits(*parts):
        return F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)), *parts))

    def number(text, place):
        return F.conv(F.substring(text, place, F.lit(8)), 16, 10).cast("bigint")

    def draw(*parts):
        return number(digits(*parts), F.lit(1))

    length = F.lit(min_len) + draw(F.lit("len")) % (max_len - min_len + 1)
    def four(block):
        hashed = digits(F.lit("aa"), block.cast("string"))
        return F.concat(*[F.substring(F.lit(RESIDUES), (number(hashed, F.lit(k)) % 20 + 1).cast("int"), F.lit(1)) for k in (1, 9, 17, 25)])

    blocks = F.transform(F.sequence(F.lit(1), F.ceil(F.greatest(length, F.lit(1)) / 4).cast("int")), four)
    letters = F.substring(F.array_join(blocks, ""), F.lit(1), length.cast("int"))
    count = (F.lit(1) + draw(F.lit("k")) % 3).cast("int")
    terms = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.concat(F.lit("GO:"), F.lpad((draw(F.lit("t"), i.cast("string")) % n_terms).cast("string"), 7, "0")),
        )
    )
    return base.select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("entry_id"), letters.alias("sequence"),
        F.array_sort(terms).alias("terms"),
    )
