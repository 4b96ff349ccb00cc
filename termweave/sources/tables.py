"""Scans of the tabular text inputs (SC05-SC07, SC09, SC10, SC23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import normalise_aspect
from .arrays import ingest_arrays

TASK_ROWS = 500_000  # rows that a task groups in memory


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan that has fewer partitions than cores; larger scans stay as they are.

    For CPU-heavy work on wide text rows of a few small files. At scale a scan has many more
    partitions than cores, and no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def dealt_by(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by ``key`` into partitions of about ``rows``, as many as the table asks for.

    Everything that is grouped by the key and more stays in these partitions, so nothing else is shuffled and a
    task's memory does not grow with the table. For keys with few rows each.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), key)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """SC05: whitespace-separated table with a header -> entry_id, term, aspect (C, F or P).

    Header names are matched in any case; a missing column is an error. Only the header line of the
    first file is looked at on the driver.
    """
    lines = spark.read.text(path)
    first = lines.first()
    names = (first[0] if first else "").split()
    lowered = [n.lower() for n in names]
    where = {}
    for out, accepted in {"entry_id": ("entryid", "entry_id"), "term": ("term",), "aspect": ("aspect",)}.items():
        found = [lowered.index(a) for a in accepted if a in lowered]
        if not found:
            raise ValueError(f"annotation table lacks column {out!r}: {names}")
        where[out] = found[0]
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "").withColumn("_p", parts)
    is_header = F.lower(F.get("_p", F.lit(where["entry_id"]))).isin("entryid", "entry_id") & (
        F.lower(F.get("_p", F.lit(where["term"]))) == "term"
    )
    out = rows.filter(~is_header).select(*[F.get("_p", F.lit(i)).alias(n) for n, i in where.items()])
    return out.withColumn("aspect", normalise_aspect(F.col("aspect"))).filter(F.col("aspect").isin("C", "F", "P"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """SC06: two columns without header, tab-separated, trimmed; a missing file gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.TAXONOMY)
    raw = spark.read.schema(schemas.TAXONOMY).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    return raw.select(F.trim("entry_id").alias("entry_id"), F.trim("tax_id").alias("tax_id"))


def read_term_weights(spark: SparkSession, path: str) -> DataFrame:
    """SC07: ``term ia`` pairs separated by white space; a missing or unreadable weight is 0."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    weight = F.expr("try_cast(get(_p, 1) AS DOUBLE)")
    weight = F.when(weight.isNull() | F.isnan(weight), F.lit(0.0)).otherwise(weight)
    return rows.withColumn("_p", parts).select(F.get("_p", F.lit(0)).alias("term"), weight.alias("ia"))


def read_weight_vector(spark: SparkSession, path: str, vocab: DataFrame, key: str = "weights") -> DataFrame:
    """SC07, vector form: ``.npy`` or ``.npz`` files (array ``key``) by vocabulary index -> term, ia.

    ``vocab`` has ``term, idx``; a term beyond the vector, or a weight that is no number, has weight 0. An
    archive without the key is an error.
    """
    found = ingest_arrays(spark, path, key)
    wrong = F.raise_error(F.concat(F.lit("no weights in "), F.col("artefact"), F.lit(": "), F.col("error")))
    values = F.when(F.col("error").isNull(), F.col("values")).otherwise(wrong.cast("array<double>"))
    weights = found.select(F.posexplode(values).alias("idx", "ia"))
    return vocab.join(weights, "idx", "left").select("term", F.coalesce(F.nanvl("ia", F.lit(0.0)), F.lit(0.0)).alias("ia"))


def term_column(columns: list[str]) -> list[str]:
    """Columns that hold term lists: ``go_terms``, else names with ``go`` in them or ending in ``terms``."""
    if "go_terms" in columns:
        return ["go_terms"]
    found = [c for c in columns if "go" in c.lower() or c.lower().endswith("terms")]
    if not found:
        raise ValueError("no term column: expected 'go_terms', a name with 'go', or one ending in 'terms'")
    return found


def explode_term_cells(df: DataFrame, column: str | None = None, prefix: str = "GO:") -> DataFrame:
    """SC09: list-valued text cells -> the other columns and one row per ``term``.

    A cell is a bracketed list literal, or is cut at the first of ``;`` ``,`` ``|`` it contains, or is
    a single item; items must start with the prefix in any case.
    """
    columns = [column] if column else term_column(df.columns)
    parts = []
    for name in columns:
        text = F.trim(F.col(name))
        listed = F.rlike(text, F.lit(r"^[\[\(\{].*[\]\)\}]$"))
        quoted = F.transform(
            F.regexp_extract_all(text, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)),
            lambda item: F.substring(item, F.lit(2), F.length(item) - 2),
        )
        cutter = F.when(F.contains(text, F.lit(";")), ";").when(F.contains(text, F.lit(",")), ",").otherwise("|")
        items = F.when(listed, quoted).otherwise(F.split(text, F.concat(F.lit(r"\Q"), cutter, F.lit(r"\E"))))
        kept = F.filter(F.transform(items, lambda item: F.trim(item)), lambda t: F.startswith(F.upper(t), F.lit(prefix)))
        others = [c for c in df.columns if c not in columns]
        parts.append(df.select(*others, F.explode(kept).alias("term")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """SC10: distinct trimmed ids of a CSV with a mandatory ``entry_id`` column."""
    frame = spark.read.option("header", True).csv(path)
    if "entry_id" not in frame.columns:
        raise ValueError("id list must include an 'entry_id' column")
    return frame.select(F.trim("entry_id").alias("entry_id")).distinct()


def read_predicted_ids(spark: SparkSession, path: str) -> DataFrame:
    """SC23: distinct first fields of a prediction table, blank ones skipped."""
    first = F.trim(F.get(F.split("value", "\t"), F.lit(0)))
    return spark.read.text(path).select(first.alias("entry_id")).filter("entry_id <> ''").distinct()
