"""Manifest scan (SC13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written
from ..schemas import MANIFEST_RECORD


def _not_a_manifest(name: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not a manifest: "), name.cast("string")))


def parse_manifests(df: DataFrame, json_col: str = "text", record: T.StructType = MANIFEST_RECORD) -> DataFrame:
    """Manifest texts (``manifest``, JSON) -> manifest, record (position), the fields of ``record``, and
    ``record_json`` with the whole record, so that fields the schema does not name are kept.

    A manifest is a JSON list, or an object with a ``records`` list; anything else is an error.
    """
    raw = T.ArrayType(T.StringType())
    text = F.trim(F.col(json_col))
    as_list = F.from_json(text, raw, {"mode": "FAILFAST"})
    as_object = F.from_json(text, T.StructType([T.StructField("records", raw)]), {"mode": "FAILFAST"})["records"]
    records = F.when(F.startswith(text, F.lit("[")), as_list).when(F.startswith(text, F.lit("{")), as_object)
    records = F.when(records.isNotNull(), records).otherwise(F.from_json(_not_a_manifest(F.col("manifest")).cast("string"), raw))
    return _with_fields(df.select("manifest", F.posexplode(records).alias("record", "record_json")), record)


def _with_fields(single: DataFrame, record: T.StructType) -> DataFrame:
    parsed = single.withColumn("r", F.from_json("record_json", record, {"mode": "FAILFAST"}))
    return parsed.select("manifest", F.col("record").cast("bigint").alias("record"), "r.*", "record_json")


def _depth(text: Column) -> Column:
    """Brackets and braces that a text without strings opens, less those that it closes."""
    opened = F.length(text) - F.length(F.translate(text, "{[", ""))
    return opened - (F.length(text) - F.length(F.translate(text, "}]", "")))


def manifest_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files cut behind each ``}``, read by byte ranges: file, block (start of the range), pos (order in
    it), value (without the brace), and what a piece does to the reader's state.

    The state is the depth and whether the piece begins inside a string, which is not known yet: ``quotes`` counts
    the quotes that are not escaped, ``out`` and ``inside`` the change of depth if it begins outside or inside.
    """
    value = F.col("value")
    bare = F.regexp_replace(value, r"(?s)\\.", "")  # a cut never separates an escape from its character
    even = F.col("quotes") % 2 == 0

    def change(text: Column, ends_outside: Column) -> Column:
        return _depth(F.regexp_replace(text, '"[^"]*("|\\z)', "")) - F.when(ends_outside, 1).otherwise(0)

    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value", bare.alias("bare"),
    )
    counted = pieces.withColumn("quotes", F.length("bare") - F.length(F.translate("bare", '"', "")))
    return counted.select(
        "file", "size", "block", "pos", "value", "quotes", change(F.col("bare"), even).alias("out"),
        change(F.regexp_replace("bare", '\\A[^"]*("|\\z)', ""), ~even).alias("inside"),
    )


def _before(column: str, order: str, keys: list[str]) -> Column:
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(frame), F.lit(0))


def manifest_texts(pieces: DataFrame) -> DataFrame:
    """Pieces -> file, kind (``[`` a list, ``{`` an object, else neither), record and text.

    A list gives a row for each record; any other file one row with its whole text. States are summed inside byte
    ranges and then over the ranges of a file, so no task holds more than a range, or one record.
    """
    split = ["file", "block"]
    mark = F.substring(F.regexp_extract("value", r"\A\s*(\S?)", 1), 1, 1)
    local = pieces.withColumn("odd", _before("quotes", "pos", split) % 2)
    either = [F.when(F.col("odd") == s, F.col("out")).otherwise(F.col("inside")).alias(f"d{s}") for s in (0, 1)]
    local = local.select("*", *either)
    ranges = local.groupBy(*split, "size").agg(
        F.sum("quotes").alias("q"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"),
        F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("bytes"), F.min_by(mark, "pos").alias("mark"),
    )
    whole = Window.partitionBy("file")
    ranges = ranges.withColumn("s", _before("q", "block", ["file"]) % 2)
    ranges = ranges.withColumn("d", F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1")))
    ranges = ranges.select(
        *split, "s", _before("d", "block", ["file"]).alias("depth"), F.sum("d").over(whole).alias("end"),
        F.min_by("mark", "block").over(whole).alias("kind"),
        # whether the last piece was cut at a brace or at the end of the file
        (F.sum("bytes").over(whole) > F.col("size")).alias("open_end"),
    )
    inside = Window.partitionBy(*split).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = local.join(ranges, split)
    placed = placed.withColumn("reached", F.col("depth") + F.sum(F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1"))).over(inside))
    at_end = (F.col("kind") == "[") & (F.col("reached") == 1) & ((F.col("odd") + F.col("s") + F.col("quotes")) % 2 == 0)
    placed = placed.withColumn("closes", at_end.cast("int"))
    ends = placed.groupBy(*split).agg(F.sum("closes").alias("n"))
    ends = ends.select(*split, _before("n", "block", ["file"]).alias("first"))
    numbered = placed.withColumn("record", _before("closes", "pos", split)).join(ends, split)
    grouped = numbered.groupBy("file", "kind", "open_end", "end", (F.col("first") + F.col("record")).alias("record")).agg(
        F.array_sort(F.collect_list(F.struct("block", "pos", "value")))["value"].alias("values"), F.max("closes").alias("full")
    )
    text = F.concat(F.array_join("values", "}"), F.when((F.col("full") == 1) | ~F.col("open_end"), "}").otherwise(""))
    texts = grouped.select("file", "kind", "record", "full", "open_end", "end", text.alias("text"))
    # what is left behind the last record, and the depth at the end, tell a list that was cut off
    rest = F.when(F.col("record") == 0, F.rlike("text", F.lit(r"\A\s*\[\s*\]\s*\z"))).otherwise(F.rlike("text", F.lit(r"\A\s*\]\s*\z")))
    sound = F.col("open_end") & (F.col("end") == -1) & ((F.col("full") == 1) | rest)
    checked = F.when((F.col("kind") != "[") | sound, F.col("text")).otherwise(_not_a_manifest(F.col("file")).cast("string"))
    texts = texts.withColumn("text", checked).filter(F.col("text").isNotNull())
    return texts.filter((F.col("kind") != "[") | (F.col("full") == 1)).select("file", "kind", "record", "text")


def read_manifest(spark: SparkSession, path: str, record: T.StructType = MANIFEST_RECORD, name: Column | None = None) -> DataFrame:
    """SC13: manifest files -> one row per record, as :func:`parse_manifests` gives them.

    A JSON list is read by byte ranges in many tasks, however large it is. An object with a ``records`` list is put
    together again and parsed by one task; the record-per-line sink of this package (SC16) has no such limit.
    ``name`` makes the manifest's name from the column ``file``, its path; by default the last part.
    """
    texts = manifest_texts(written(manifest_pieces(spark, path), "manifest-pieces"))
    texts = texts.withColumn("manifest", name if name is not None else F.regexp_extract("file", r"([^/]+)$", 1))
    body = F.regexp_replace("text", r"\A\s*[\[,]\s*", "")
    listed = _with_fields(texts.filter("kind = '['").select("manifest", "record", body.alias("record_json")), record)
    return listed.unionByName(parse_manifests(texts.filter("kind <> '['").select("manifest", "text"), record=record))


def manifest_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata objects of manifest files -> manifest, meta (map of text)."""
    shape = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("manifest"), F.from_json("value", shape)["meta"].alias("meta")
    )
