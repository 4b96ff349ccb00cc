"""Exact global ranks and running totals that never put all rows, or one hot group, in one task.

Spark's range partitioner deals the rows into ordered partitions by (keys, value, hash of the id, id),
so any type with an order works, NULL and NaN included, and a hot key or value is split by the hash.
The dealt rows are written once with the number of their partition; a row's position inside its
partition is then shifted by the rows of its group in the partitions before, which is a table of one
row per partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written


def seeded_hash(col: Column, seed: object = None) -> Column:
    """Order key of all seeded draws: md5 of the id, followed by ``|seed`` when one is given."""
    text = col.cast("string")
    return F.md5(text if seed is None else F.concat(text, F.lit(f"|{seed}")))


def dealt(df: DataFrame, order: Sequence[str], name: str, out: str = "_p") -> DataFrame:
    """The rows in ordered partitions by ``order``, written once, with the partition's number in ``out``."""
    return written(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()), name)


def same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL equals NULL; the columns come from the left side."""
    names = {c: f"_right_{c}" for c in columns}
    renamed = right.withColumnsRenamed(names)
    condition = reduce(Column.__and__, (left[c].eqNullSafe(renamed[n]) for c, n in names.items()))
    return left.join(renamed, condition, how).drop(*names.values())


def global_rank(
    df: DataFrame,
    id_col: str,
    value: str | None = None,
    keys: Sequence[str] = (),
    seed: object = None,
    out: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """1-based exact rank by (value, md5 of the id, id) within ``keys``; optionally the group size.

    NULL values come first and NaN last, and a NULL key is a group like any other. Keep the input
    narrow: it is computed twice (partition bounds, rows) and its rows are written once.
    """
    keys, line = list(keys), [*([value] if value else []), "_h", id_col]
    rows = dealt(df.withColumn("_h", seeded_hash(F.col(id_col), seed)), [*keys, *line], "ranked")
    where = ["_p", *keys]
    counts = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))
    scope = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("_n").over(scope.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*where, F.coalesce(before, F.lit(0)).alias("_off"), F.sum("_n").over(scope).alias("_tot"))
    local = F.row_number().over(Window.partitionBy(*where).orderBy(*line))
    ranked = same(rows.withColumn("_r", local), offsets, where)
    picked = [*df.columns, (F.col("_off") + F.col("_r")).cast("bigint").alias(out)]
    if total:
        picked.append(F.col("_tot").cast("bigint").alias(total))
    return ranked.select(*picked)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], descending: bool = True
) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys`` (order values distinct per key).

    ``sums`` maps an input column to the name of its running total. A NULL key is a group, a NULL
    order value comes first ascending and last descending.
    """
    keys = list(keys)
    rows = dealt(df, [*keys, order], "totals")
    where = ["_p", *keys]
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = rows.groupBy(*where).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(turn("_p")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*where, *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*where).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    joined = same(local, offsets, where)
    return joined.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(n) for c, n in sums.items()])


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SO01: deterministic total order."""
    return df.orderBy(*keys)


def by_length(df: DataFrame, length: str = "length", id_col: str = "entry_id") -> DataFrame:
    """SO04: similar lengths land in the same partition, sorted; a frequent length is split by the id's hash."""
    spread = F.xxhash64(F.col(id_col))
    return df.repartitionByRange(F.col(length), spread).sortWithinPartitions(length)
