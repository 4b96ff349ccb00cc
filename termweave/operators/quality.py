"""Data-quality checks (DQ01-DQ11, PF07). Each returns issue rows: manifest, record, code, detail.

Manifest records carry ``manifest, record`` and, as needed, ``embedding ARRAY<ARRAY<..>>`` or
``ARRAY``, ``labels ARRAY<DOUBLE>``, ``lengths ARRAY<BIGINT>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bad(x: Column) -> Column:
    value = x.cast("double")
    return F.isnan(value) | (F.abs(value) == float("inf"))


def _issue(df: DataFrame, when: Column, code: str, detail: Column | str = "", record: Column | None = None) -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    who = F.col("record").cast("string") if record is None else record
    return df.filter(when).select(
        F.col("manifest").cast("string").alias("manifest"), who.alias("record"), F.lit(code).alias("code"), text.alias("detail")
    )


def union_issues(parts: Sequence[DataFrame]) -> DataFrame:
    """All issue rows of several checks."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_embeddings(df: DataFrame) -> DataFrame:
    """DQ01: embedding missing, not 2-D (rows of unequal width), or non-finite. One pass per record."""
    ragged = F.size(F.array_distinct(F.transform("embedding", F.size))) > 1
    nonfinite = F.exists("embedding", lambda row: F.exists(row, _bad))
    found = F.array_compact(
        F.array(
            F.when(F.col("embedding").isNull(), F.lit("embedding_missing")),
            F.when(ragged, F.lit("embedding_not_2d")),
            F.when(nonfinite, F.lit("embedding_nonfinite")),
        )
    )
    return df.select(
        F.col("manifest").cast("string").alias("manifest"), F.col("record").cast("string").alias("record"),
        F.explode(found).alias("code"), F.lit("").alias("detail"),
    )


def check_labels(df: DataFrame) -> DataFrame:
    """DQ02: labels missing (null or empty) or non-finite."""
    missing = F.col("labels").isNull() | (F.size("labels") == 0)
    found = F.array_compact(
        F.array(
            F.when(missing, F.lit("labels_missing")),
            F.when(F.exists("labels", _bad), F.lit("labels_nonfinite")),
        )
    )
    return df.select(
        F.col("manifest").cast("string").alias("manifest"), F.col("record").cast("string").alias("record"),
        F.explode(found).alias("code"), F.lit("").alias("detail"),
    )


def check_lengths(df: DataFrame) -> DataFrame:
    """DQ03: recorded length differs from the embedding's, or is not a single number."""
    odd = F.col("lengths").isNotNull() & (F.size("lengths") != 1)
    rows = F.size("embedding")
    differs = (F.size("lengths") == 1) & (F.get("lengths", F.lit(0)) != rows)
    detail = F.concat(rows.cast("string"), F.lit(" vs "), F.get("lengths", F.lit(0)).cast("string"))
    return _issue(df, odd, "lengths_shape", F.size("lengths").cast("string")).unionByName(
        _issue(df, differs, "length_mismatch", detail)
    )


def check_term_prior(priors: DataFrame, vocab: DataFrame, label_sizes: DataFrame) -> DataFrame:
    """DQ04: a term prior in sparse form ``manifest, parent, child, weight``: an index outside the
    vocabulary (not square), non-finite weights, or a size other than the manifest's label size.
    ``vocab`` has ``manifest, idx``; ``label_sizes`` has ``manifest, label_size``."""
    sizes = vocab.groupBy("manifest").agg(F.count(F.lit(1)).alias("_n"))
    held = priors.join(sizes, "manifest", "left")
    ends = held.groupBy("manifest").agg(
        F.count_if((F.greatest("parent", "child") >= F.coalesce("_n", F.lit(0))) | (F.least("parent", "child") < 0)).alias("_out"),
        F.count_if(_bad(F.col("weight"))).alias("_bad"),
        F.max("_n").alias("_n"),
    )
    joined = ends.join(label_sizes, "manifest", "left")
    none = F.lit("")
    return union_issues(
        [
            _issue(joined, F.col("_out") > 0, "term_prior_not_square", F.col("_out").cast("string"), none),
            _issue(joined, F.col("_bad") > 0, "term_prior_nonfinite", F.col("_bad").cast("string"), none),
            _issue(
                joined,
                F.col("label_size").isNotNull() & (F.col("_n") != F.col("label_size")),
                "term_prior_size",
                F.concat(F.col("_n").cast("string"), F.lit(" vs "), F.col("label_size").cast("string")),
                none,
            ),
        ]
    )


def check_pair_prior(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """DQ05: a pair prior in sparse form ``manifest, i, j, weight``: out-of-range indices (not
    square), non-finite weights; and records whose ``prior_index`` is out of bounds."""
    sizes = members.groupBy("manifest").agg(F.count(F.lit(1)).alias("_n"))
    ends = pairs.join(sizes, "manifest", "left").groupBy("manifest").agg(
        F.count_if((F.greatest("i", "j") >= F.coalesce("_n", F.lit(0))) | (F.least("i", "j") < 0)).alias("_out"),
        F.count_if(_bad(F.col("weight"))).alias("_bad"),
    )
    bounds = members.join(sizes, "manifest").filter((F.col("prior_index") < 0) | (F.col("prior_index") >= F.col("_n")))
    none = F.lit("")
    return union_issues(
        [
            _issue(ends, F.col("_out") > 0, "pair_prior_not_square", F.col("_out").cast("string"), none),
            _issue(ends, F.col("_bad") > 0, "pair_prior_nonfinite", F.col("_bad").cast("string"), none),
            _issue(bounds, F.lit(True), "pair_index_out_of_bounds", F.col("prior_index").cast("string")),
        ]
    )


def check_label_sizes(df: DataFrame, manifests: DataFrame) -> DataFrame:
    """DQ06: more than one label size in a manifest; a manifest without records."""
    sizes = df.filter(F.size("labels") > 0).select("manifest", F.size("labels").alias("_s")).distinct()
    kinds = sizes.groupBy("manifest").agg(F.count(F.lit(1)).alias("_k"), F.min("_s").alias("_a"), F.max("_s").alias("_z"))
    spread = F.concat(F.col("_a").cast("string"), F.lit(".."), F.col("_z").cast("string"))
    empty = manifests.select("manifest").distinct().join(df.select("manifest"), "manifest", "left_anti")
    return _issue(kinds, F.col("_k") > 1, "label_sizes_differ", spread, F.lit("")).unionByName(
        _issue(empty, F.lit(True), "manifest_empty", "", F.lit(""))
    )


def check_width(df: DataFrame, configured: int | None = None) -> DataFrame:
    """DQ07: embedding width not constant (error), or different from the configured one (warning)."""
    widths = df.select("manifest", F.size(F.get("embedding", F.lit(0))).alias("_w")).groupBy("manifest").agg(
        F.min("_w").alias("_lo"), F.max("_w").alias("_hi")
    )
    span = F.concat(F.col("_lo").cast("string"), F.lit(".."), F.col("_hi").cast("string"))
    out = _issue(widths, F.col("_lo") != F.col("_hi"), "width_not_constant", span, F.lit(""))
    if configured is not None:
        other = (F.col("_lo") != configured) | (F.col("_hi") != configured)
        out = out.unionByName(_issue(widths, other, "width_not_configured", span, F.lit("")))
    return out


def check_edges(df: DataFrame) -> DataFrame:
    """DQ08: edge arrays of a graph artefact: ``edge_index`` needs two equal rows, as many weights as
    edges, and finite weights."""
    shaped = (F.size("edge_index") == 2) & (F.size(F.get("edge_index", F.lit(0))) == F.size(F.get("edge_index", F.lit(1))))
    shaped = F.coalesce(shaped, F.lit(False))
    counted = F.size(F.get("edge_index", F.lit(0))) == F.size("edge_weight")
    return union_issues(
        [
            _issue(df, ~shaped, "edge_index_shape"),
            _issue(df, shaped & ~counted, "edge_weight_count", F.size("edge_weight").cast("string")),
            _issue(df, F.exists("edge_weight", _bad), "edge_weight_nonfinite"),
        ]
    )


def check_score_terms(vocab: DataFrame, scores: DataFrame) -> DataFrame:
    """DQ09: vocabulary terms never scored, and scored terms outside the vocabulary."""
    scored = scores.select("term").distinct()
    known = vocab.select("term").distinct()

    def rows(df: DataFrame, code: str) -> DataFrame:
        return df.select(F.lit("").alias("manifest"), F.col("term").cast("string").alias("record"), F.lit(code).alias("code"), F.lit("").alias("detail"))

    return rows(known.join(scored, "term", "left_anti"), "term_not_scored").unionByName(
        rows(scored.join(known, "term", "left_anti"), "term_unknown")
    )


def check_partitions(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """DQ10: expected partitions (manifests) without any row."""
    wanted = df.sparkSession.createDataFrame([(e,) for e in expected], "manifest string")
    missing = wanted.join(df.select(F.col("manifest").cast("string").alias("manifest")), "manifest", "left_anti")
    return _issue(missing, F.lit(True), "partition_missing", "", F.lit(""))


def quality_report(issues: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """DQ10: issues per manifest (0 for clean ones) and in total (manifest ``*``)."""
    counts = issues.groupBy("manifest").agg(F.count(F.lit(1)).alias("n_issues"))
    if manifests is not None:
        everyone = manifests.select(F.col("manifest").cast("string").alias("manifest")).distinct()
        counts = everyone.join(counts, "manifest", "full_outer").select("manifest", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))
    total = counts.agg(F.coalesce(F.sum("n_issues"), F.lit(0)).alias("n_issues")).select(F.lit("*").alias("manifest"), "n_issues")
    return counts.unionByName(total)


def check_meta(meta: DataFrame, aspect: str) -> DataFrame:
    """DQ11: manifest metadata of another aspect, or without ``num_functions``."""
    return _issue(meta, F.col("aspect") != aspect, "aspect_mismatch", F.col("aspect"), F.lit("")).unionByName(
        _issue(meta, F.col("num_functions").isNull(), "num_functions_missing", "", F.lit(""))
    )


def length_issues(df: DataFrame) -> DataFrame:
    """PF07: sequence, embedding and structure lengths of an entry must agree (null = not given)."""
    seq, emb, struct = F.col("sequence_length"), F.col("embedding_length"), F.col("structure_length")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    detail = F.concat_ws("/", text(seq), text(emb), text(struct))
    off = F.coalesce(seq != emb, F.lit(False)) | F.coalesce(emb != struct, F.lit(False))
    return _issue(df, off, "length_mismatch", detail)
