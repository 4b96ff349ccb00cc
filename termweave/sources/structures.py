"""Structure scans (SC11, SC12, PF19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FRAGMENT_ITEM


def read_atoms(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """SC11: atom files -> model_id (file name without extension), pos, x, y, z, conf."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return read_atoms_from(spark.read.text(path), name, strict)


def read_atoms_from(files: DataFrame, model_id: Column, strict: bool = True) -> DataFrame:
    """SC11 over a text scan with any naming of models.

    Rows starting ``ATOM`` with atom name ``CA`` count; a short or unreadable one raises, and with
    ``strict`` so does a model without any. One model is one file of one protein, so numbering its
    residues is a window over a bounded group.
    """
    rows = files.select(
        "value",
        model_id.alias("model_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    is_ca = F.startswith("value", F.lit("ATOM")) & (F.trim(F.substring("value", 13, 4)) == "CA")
    broken = F.raise_error(F.concat(F.lit("unreadable atom row: "), F.col("value"))).cast("double")

    def number(start: int, width: int) -> Column:
        text = F.trim(F.substring("value", start, width))
        value = text.try_cast("double")
        return F.when((F.length("value") >= 66) & value.isNotNull(), value).otherwise(broken)

    atoms = rows.filter(is_ca).select(
        "model_id", "_file", "_block", "_row",
        number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), number(61, 6))).alias("conf"),
    )
    w = Window.partitionBy("model_id").orderBy("_file", "_block", "_row")
    out = atoms.select("model_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "x", "y", "z", "conf")
    if strict:
        counts = rows.groupBy("model_id").agg(F.count_if(is_ca).alias("_n"))
        lost = F.raise_error(F.concat(F.lit("no CA atoms in model "), F.col("model_id")))
        empty = counts.filter(F.col("_n") == 0).select(
            F.when(F.col("_n") == 0, lost).cast("string").alias("model_id"), F.lit(0).cast("bigint").alias("pos"),
            *[F.lit(0.0).alias(c) for c in ("x", "y", "z", "conf")],
        )
        out = out.unionByName(empty)
    return out


def fragment_bounds(item: Column) -> Column:
    """PF19: struct start, end, length of a metadata item.

    The first of the two fields that is a non-zero integer counts; missing bounds come from the
    sequence length; a non-positive length, or neither bounds nor sequence, is an error.
    """

    def first_whole(*names: str) -> Column:
        return F.coalesce(*[F.nullif(item[n].try_cast("int"), F.lit(0)) for n in names])

    start, end = first_whole("sequenceStart", "uniprotStart"), first_whole("sequenceEnd", "uniprotEnd")
    size = F.length(item["sequence"])
    where = F.concat(start.cast("string"), F.lit(".."), end.cast("string"))
    bad = F.raise_error(F.concat(F.lit("invalid fragment bounds "), where)).cast("int")
    none = F.raise_error(F.lit("fragment has neither bounds nor sequence")).cast("int")
    first = F.coalesce(start, F.lit(1))
    span = end - start + 1
    length = F.when(span > 0, span).when(span.isNotNull(), bad).when(size.isNull(), none).otherwise(size)
    return F.struct(first.alias("start"), F.coalesce(end, first + size - 1).alias("end"), length.alias("length"))


def read_fragments(df: DataFrame, json_col: str = "metadata") -> DataFrame:
    """SC12: JSON list of structure metadata per entry -> entry_id, accession, model_id, url, start, end, length."""
    items = F.from_json(F.col(json_col), T.ArrayType(FRAGMENT_ITEM), {"mode": "FAILFAST"})
    rows = df.select("entry_id", F.explode(items).alias("m"))
    filled = lambda name: F.nullif(F.col(f"m.{name}"), F.lit(""))
    accession = F.coalesce(filled("uniprotAccession"), filled("entryId"), filled("uniprotId"), F.col("entry_id").cast("string"))
    url = F.coalesce(filled("pdbUrl"), F.raise_error(F.lit("structure metadata lacks pdbUrl")).cast("string"))
    rows = rows.withColumn("accession", accession).withColumn("b", fragment_bounds(F.col("m")))
    return rows.select(
        "entry_id", "accession", F.coalesce(filled("modelEntityId"), filled("entryId"), F.col("accession")).alias("model_id"),
        url.alias("url"), F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.length").alias("length"),
    )


def read_fragment_files(spark: SparkSession, path: str) -> DataFrame:
    """SC12 from files: one JSON list per file, the entry id is the file name."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("entry_id"), F.col("value").alias("metadata")
    )
    return read_fragments(files)
