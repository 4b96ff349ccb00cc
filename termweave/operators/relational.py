"""Joins, reconciliation, assembly and set operations (JN*, ST05-ST08, SC04, PF08, PF09)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIEVE_BITS = 1 << 26  # bits of a sieve at most (8 MB)


def sieved(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key may be in ``keys``, a written table, found without a shuffle: the first step of an exact join.

    A sieve has 16 bits or more for each key, up to ``SIEVE_BITS``; the bit at a key's hash is set. A row whose bit is not set
    goes; of the others few are not in ``keys``, and the join that follows drops them.
    """
    on = list(on)
    if [df.schema[c].dataType for c in on] != [keys.schema[c].dataType for c in on]:
        return df  # equal keys of two types have two hashes
    bits = min(SIEVE_BITS, 1 << max(10, (16 * keys.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at").bitwiseAND(F.lit(63)).cast("int"))
    found = keys.select(place.alias("_at")).select(F.shiftright("_at", 6).alias("_w"), bit.alias("_b"))
    filled = found.groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    every = df.sparkSession.range(bits >> 6).select(F.col("id").alias("_w")).join(filled, "_w", "left")
    words = every.select(F.struct("_w", F.coalesce("_b", F.lit(0).cast("bigint")).alias("_b")).alias("_s")).agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    word = F.get(words.select(F.col("_s._b")).scalar(), F.shiftright(place, 6).cast("int"))
    kept = df.withColumn("_at", place).filter(word.bitwiseAND(bit) != 0)
    return kept.drop("_at")


def not_in(df: DataFrame, ids: DataFrame, on: str | Sequence[str] = "entry_id") -> DataFrame:
    """JN01: rows whose key is absent from ``ids``."""
    return df.join(ids, on, "left_anti")


def only_in(df: DataFrame, ids: DataFrame, on: str | Sequence[str] = "entry_id") -> DataFrame:
    """JN03: rows whose key is in ``ids``; Spark broadcasts ``ids`` only when its size allows."""
    return df.join(ids, on, "left_semi")


def resume(df: DataFrame, predicted: DataFrame) -> DataFrame:
    """JN09: entries without earlier predictions."""
    return not_in(df, predicted.select("entry_id"), "entry_id")


def restrict(annotations: DataFrame, entries: DataFrame, aspect: str | None = None) -> DataFrame:
    """JN02: annotations of the given entries, of one aspect when named."""
    rows = annotations if aspect is None else annotations.filter(F.col("aspect") == aspect)
    return rows.join(entries.select("entry_id"), "entry_id", "left_semi")


def with_taxonomy(df: DataFrame, taxonomy: DataFrame, default: str = "") -> DataFrame:
    """JN04: taxonomy id per row, ``default`` when unknown."""
    joined = df.join(taxonomy.select("entry_id", "tax_id"), "entry_id", "left")
    return joined.withColumn("tax_id", F.coalesce("tax_id", F.lit(default)))


def project_labels(annotations: DataFrame, vocab: DataFrame, entries: DataFrame) -> DataFrame:
    """JN05: per entry the vocabulary indices it carries; an entry without any keeps one null row."""
    inside = annotations.select("entry_id", "term").distinct().join(vocab.select("term", "idx"), "term")
    return entries.select("entry_id").distinct().join(inside, "entry_id", "left").select("entry_id", "term", "idx")


def split_known_terms(freq: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN06: frequencies with the ontology's aspect, and the terms the ontology does not know."""
    bare = freq.drop("aspect")
    return bare.join(terms, "term"), bare.join(terms, "term", "left_anti")


def reconcile(entries: DataFrame, artefacts: DataFrame) -> DataFrame:
    """JN07: which entries already have their artefact."""
    have = artefacts.select("entry_id").distinct().withColumn("_have", F.lit(1))
    return entries.select("entry_id").join(have, "entry_id", "left").select(
        "entry_id", F.coalesce("_have", F.lit(0)).alias("is_cached")
    )


def with_fallback(entries: DataFrame, primary: DataFrame, secondary: DataFrame, strict: bool = False) -> DataFrame:
    """JN08: primary source when usable, else secondary with the reason, else ``none``.

    ``primary`` has ``entry_id, n_items, length_ok, file_ok`` (one row per known entry). With
    ``strict`` an entry without any source raises.
    """
    second = secondary.select("entry_id").distinct().withColumn("_second", F.lit(True))
    joined = entries.select("entry_id").join(primary, "entry_id", "left").join(second, "entry_id", "left")
    reason = (
        F.when(F.col("n_items").isNull(), "metadata not found")
        .when(F.col("n_items") == 0, "empty metadata")
        .when(~F.col("length_ok"), "no length match")
        .when(~F.col("file_ok"), "file not found")
    )
    missing = F.raise_error(F.concat(F.lit("no source for entry "), F.col("entry_id").cast("string"))) if strict else F.lit("none")
    source = F.when(F.col("reason").isNull(), "primary").when(F.col("_second"), "secondary").otherwise(missing)
    return joined.withColumn("reason", reason).select("entry_id", source.alias("source"), "reason")


def first_annotated(sequences: DataFrame, annotations: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """JN10: the first n annotated entries in file order, empty sequences skipped (top-n, no full sort)."""
    held = sequences.filter(F.length("sequence") > 0).join(annotations.select("entry_id"), "entry_id", "left_semi")
    return held.orderBy(order).limit(n)


def mutual(edges: DataFrame, keys: Sequence[str] = ("entry_id",), a: str = "i", b: str = "j") -> DataFrame:
    """JN12: keep (i, j) only when (j, i) is there too."""
    swapped = edges.select(*keys, F.col(a).alias(b), F.col(b).alias(a))
    return edges.join(swapped, [*keys, a, b], "left_semi")


def assemble(entries: DataFrame, sources: dict[str, DataFrame], on_missing: str = "skip") -> DataFrame:
    """JN14: entries joined to every source; incomplete ones are skipped, or raise with ``error``.

    Each source has one row per ``entry_id``.
    """
    out = entries
    if on_missing == "skip":
        for source in sources.values():
            out = out.join(source, "entry_id")
        return out
    for name, source in sources.items():
        flag = f"_has_{name}"
        out = out.join(source.withColumn(flag, F.lit(True)), "entry_id", "left")
        lost = F.raise_error(F.concat(F.lit(f"missing {name} for entry "), F.col("entry_id").cast("string")))
        out = out.withColumn("entry_id", F.when(F.col(flag), F.col("entry_id")).otherwise(lost)).drop(flag)
    return out


def batch_submatrix(pairs: DataFrame, batches: DataFrame) -> DataFrame:
    """JN15: the pair table restricted to one batch's members on both sides, reindexed by position."""
    left = batches.select("batch_id", F.col("pos").alias("i"), F.col("entry_id").alias("a"))
    right = batches.select("batch_id", F.col("pos").alias("j"), F.col("entry_id").alias("b"))
    return pairs.join(left, "a").join(right, ["batch_id", "b"]).select("batch_id", "i", "j", "weight")


def join_truth(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """JN16: evaluation rows: score 0 where unpredicted, label 0 where unlabelled."""
    truth = labels.select("entry_id", "term").distinct().withColumn("label", F.lit(1))
    joined = predictions.select("entry_id", "term", "score").join(truth, ["entry_id", "term"], "full_outer")
    return joined.select(
        "entry_id", "term", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("label", F.lit(0)).alias("label")
    )


def deduplicate(df: DataFrame, order: Column, policy: str = "last", key: str = "entry_id", value: str = "sequence") -> DataFrame:
    """SC04: one row per key: the first or last in file order, or an error on conflicting values.

    Only keys and positions are shuffled to find the repeated keys (usually few); the wide rows are
    then filtered against that table, so they move only when it is too large to broadcast. Repeats
    of a hot key are combined map-side.
    """
    if policy not in ("first", "last", "error"):
        raise ValueError(f"unknown duplicate policy {policy!r}")
    placed = df.withColumn("_ord", order)
    pick = F.max if policy == "last" else F.min
    found = [pick("_ord").alias("_win"), F.count(F.lit(1)).alias("_n")]
    if policy == "error":
        found += [F.min(F.md5(value)).alias("_lo"), F.max(F.md5(value)).alias("_hi")]
    repeated = placed.groupBy(key).agg(*found).filter("_n > 1")
    joined = placed.join(repeated, key, "left")
    if policy == "error":
        clash = F.raise_error(F.concat(F.lit("conflicting rows for "), F.col(key).cast("string")))
        joined = joined.withColumn(key, F.when(F.col("_lo") != F.col("_hi"), clash).otherwise(F.col(key)))
    return joined.filter(F.col("_win").isNull() | (F.col("_ord") == F.col("_win"))).select(*df.columns)


def concat_first(dfs: Sequence[DataFrame], key: str = "entry_id", order: Sequence[str] = ()) -> DataFrame:
    """ST05: tables one after another; the first row of a key wins.

    ``order`` names columns of every table that give its rows their place in the file (they are not in
    the result); without it rows of one table are ordered by value. Only keys and places are shuffled
    to find the winners.
    """
    order = list(order)
    tagged = [df.withColumn("_t", F.lit(i)) for i, df in enumerate(dfs)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    others = [c for c in dfs[0].columns if c != key and c not in order]
    if not order:
        best = rows.groupBy(key).agg(F.min(F.struct("_t", *others)).alias("_row"))
        return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])
    place = F.struct("_t", *order)
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_first"))
    kept = rows.withColumn("_place", place).join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_place") == F.col("_first")))
    return kept.select(key, *others)


def union_distinct(dfs: Sequence[DataFrame]) -> DataFrame:
    """ST06: union of selected id sets without repeats."""
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST07: ids in both tables."""
    return a.select("entry_id").intersect(b.select("entry_id"))


def minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST08: ids of the first table that are not in the second."""
    return a.select("entry_id").subtract(b.select("entry_id"))


def min_length(df: DataFrame, k: int, col: str = "length") -> tuple[DataFrame, DataFrame]:
    """PF08: rows at least k long (unknown lengths pass), and a one-row table of how many were dropped."""
    long_enough = F.col(col).isNull() | (F.col(col) >= k)
    return df.filter(long_enough), df.agg(F.count_if(~long_enough).alias("dropped"))


def noise_floor(df: DataFrame, floor: float = 0.01) -> DataFrame:
    """PF09: drop NULL and NaN scores and those below the floor, clamp the rest to 1."""
    return df.filter((F.col("score") >= floor) & ~F.isnan("score")).withColumn("score", F.least("score", F.lit(1.0)))


def combine_aspects(df: DataFrame) -> DataFrame:
    """AG23: largest score per (entry, term) over all aspects."""
    return df.groupBy("entry_id", "term").agg(F.max("score").alias("score"))
