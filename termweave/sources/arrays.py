"""Array ingest (SC14, UD03): .npy / .npz files to table rows."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ARRAY_ROWS

# Archive keys in order of preference.
KEY_PRIORITY = ["embeddings", "adjacency", "tensor", "matrix", "weights", "data", "arr_0"]


def decode_arrays(df: DataFrame, key: str | None = None, priority: Sequence[str] = KEY_PRIORITY) -> DataFrame:
    """UD03: ``artefact, content`` (bytes) -> artefact, shape, values (row-major), error.

    Unreadable content and unknown keys become error rows instead of failing the job.
    """
    wanted = [key] if key else list(priority)

    def one(content: bytes):
        loaded = np.load(io.BytesIO(content), allow_pickle=False)
        if isinstance(loaded, np.ndarray):
            return loaded
        for name in wanted:
            if name in loaded.files:
                return loaded[name]
        raise KeyError(f"none of {wanted} in {loaded.files}")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for artefact, content in zip(frame["artefact"], frame["content"]):
                try:
                    a = np.asarray(one(bytes(content)), dtype=float)
                    rows.append((artefact, list(a.shape), a.reshape(-1), None))
                except Exception as exc:  # noqa: BLE001
                    rows.append((artefact, None, None, str(exc)))
            yield pd.DataFrame(rows, columns=["artefact", "shape", "values", "error"])

    return df.select("artefact", "content").mapInPandas(work, ARRAY_ROWS)


def ingest_arrays(spark: SparkSession, path: str, key: str | None = None, priority: Sequence[str] = KEY_PRIORITY) -> DataFrame:
    """SC14: array files of a folder to rows; write the result as Parquet once and read that."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("artefact"), "content")
    return decode_arrays(named, key, priority)
