"""Ontology scan (SC08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fasta import file_order

# Namespace names and their aspect codes.
NAMESPACES = {"molecular_function": "F", "biological_process": "P", "cellular_component": "C"}


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC08: OBO files -> ``terms<term, aspect>`` and ``edges<child, parent, rel>``.

    One row per stanza (separator: line break before ``[``). Obsolete terms are dropped, the last
    definition of a term wins, other stanza kinds are ignored, only ``is_a`` and ``part_of`` count.
    """
    stanzas = spark.read.option("lineSep", "\n[").text(path).select(
        F.regexp_replace("value", r"^\[", "").alias("body"), file_order().alias("ord")
    ).filter(F.startswith("body", F.lit("Term]")))
    field = lambda name: F.trim(F.regexp_extract("body", rf"(?m)^\s*{name}: (.*)$", 1))
    many = lambda pattern: F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    aspect = F.lit(None).cast("string")
    for name, code in NAMESPACES.items():
        aspect = F.when(field("namespace") == name, code).otherwise(aspect)
    parsed = stanzas.select(
        field("id").alias("term"),
        aspect.alias("aspect"),
        many(r"(?m)^\s*is_a: (\S+)").alias("is_a"),
        many(r"(?m)^\s*relationship:\s+part_of\s+(\S+)").alias("part_of"),
        F.rlike("body", F.lit(r"(?m)^\s*is_obsolete: .*true\s*$")).alias("obsolete"),
        "ord",
    ).filter((F.col("term") != "") & ~F.col("obsolete"))
    last = parsed.groupBy("term").agg(F.max_by(F.struct("aspect", "is_a", "part_of"), "ord").alias("d"))
    links = F.concat(
        F.transform("d.is_a", lambda p: F.struct(p.alias("parent"), F.lit("is_a").alias("rel"))),
        F.transform("d.part_of", lambda p: F.struct(p.alias("parent"), F.lit("part_of").alias("rel"))),
    )
    terms = last.select("term", F.col("d.aspect").alias("aspect"))
    edges = last.select(F.col("term").alias("child"), F.inline(links)).distinct()
    return terms, edges
