"""The corpus pipeline: five stages, each written as Parquet and read again by the next one.

1. quality classifier: documents that the language model rejects go;
2. n-gram Jaccard join: of each group of near-duplicates the document with the smallest id stays;
3. suffix-array dedup: passages of 50 bytes and more that an earlier document has are cut out;
4. personal data: every span is replaced by its kind in brackets;
5. packing: the texts become pieces of token windows.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text. A null text
stays null, a row without id is kept by the first two stages, repeated rows share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import save, table
from termweave.llm.jaccard import similarity_join
from termweave.llm.packing import pack
from termweave.llm.perplexity import classify
from termweave.llm.personal import redact
from termweave.llm.repeats import remove_repeats


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids``, with columns in their order."""
    gone = ids.select(F.col("doc_id").alias("_gone")).dropna().distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def _retext(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in their order; the number of characters follows the text."""
    length = F.length("text").cast("long").alias("n_chars")
    return docs.select(*(length if c == "n_chars" else F.col(c) for c in columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = classify(docs, table(spark, sf_dir, "labels"))
    return _without(docs, verdict.filter("NOT kept").select("doc_id"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = save(similarity_join(docs), "joined")
    return _without(docs, joined.filter("id <> component").select(F.col("id").alias("doc_id")))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = "_repeat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    left = remove_repeats(docs, whole_characters=True, prefix=prefix)
    text = F.when(F.col("text").isNotNull(), F.decode(f"{prefix}kept", "UTF-8"))
    return _retext(left.withColumn("text", text), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _retext(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No SQL: the language model, the path join, the suffix sort and the tokenizer are not expressible there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
