"""Shared-storage helpers: cutting lineage and placing intermediate tables.

Everything written here goes below the folder the cluster names in ``spark.checkpoint.dir``,
so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: str | None = None


def shared_base(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _LOCAL_BASE
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _LOCAL_BASE is None:
        _LOCAL_BASE = tempfile.mkdtemp(prefix="termweave-")
    return _LOCAL_BASE


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark)}/termweave/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared folder: compressed, columnar and free of lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is dealt by key and never collected and broadcast by the driver.

    Spark takes the size of a Parquet table for that of its rows. Sorted keys take a bit or two each, so a file below
    the threshold may hold millions of them. For tables as large as the ontology or its closure.
    """
    return df.hint("merge")
