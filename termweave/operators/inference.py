"""Jobs that run a user's function over batches of rows (UD01, UD02, UD04)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .metrics import average_precision
from .relational import not_in


BATCH_VALUES = 1 << 22  # numbers of the embeddings that are returned at once


def _chunks(frame: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), size):
        yield frame.iloc[start : start + size]


def _matrices(arrays: Sequence[np.ndarray]) -> pa.Array:
    """Matrices as lists of rows, from their numbers as they lie in memory."""
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    widths = [np.full(a.shape[0], a.shape[1]) for a in arrays]
    numbers = pa.array(np.concatenate([a.ravel() for a in arrays]), pa.float64())
    rows = pa.ListArray.from_arrays(ends(np.concatenate(widths)), numbers)
    return pa.ListArray.from_arrays(ends([a.shape[0] for a in arrays]), rows)


def embed(
    df: DataFrame,
    make_fn: Callable[[], Callable[[Sequence[str]], Sequence[np.ndarray]]],
    batch_size: int = 8,
    cached: DataFrame | None = None,
) -> DataFrame:
    """UD01: residue embeddings of the entries not in ``cached`` -> entry_id, length, vec.

    ``make_fn`` builds the model once per Python worker task and returns a callable from a list of
    sequences to one (length, width) array each; a wrong length is an error.
    """
    pending = df.select("entry_id", "sequence")
    if cached is not None:
        pending = not_in(pending, cached.select("entry_id"))

    kind = df.schema["entry_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make_fn()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part["sequence"].to_pylist()
                arrays = [np.asarray(a, dtype=float) for a in fn(texts)]
                for entry, text, a in zip(part["entry_id"], texts, arrays):
                    if a.shape[0] != len(text):
                        raise ValueError(f"embedding of {entry} has {a.shape[0]} rows for {len(text)} residues")
                # few enough numbers for the 32-bit offsets of a list
                filled = np.cumsum([a.size for a in arrays]) // BATCH_VALUES
                edges = [0, *(np.flatnonzero(np.diff(filled)) + 1), len(arrays)]
                for low, high in zip(edges, edges[1:]):
                    lengths = pa.array([len(t) for t in texts[low:high]], pa.int64())
                    columns = [part["entry_id"].slice(low, high - low), lengths, _matrices(arrays[low:high])]
                    yield pa.RecordBatch.from_arrays(columns, ["entry_id", "length", "vec"])

    return pending.mapInArrow(work, f"entry_id {kind}, length bigint, vec array<array<double>>")


def score(
    df: DataFrame,
    make_fn: Callable[[], Callable[[Sequence[str]], np.ndarray]],
    terms: Sequence[str],
    batch_size: int = 64,
) -> DataFrame:
    """UD02: term probabilities from a model -> entry_id, term, prob (long form)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        names = np.asarray(terms, dtype=object)
        for frame in frames:
            for part in _chunks(frame, batch_size):
                probs = np.asarray(fn(part["sequence"].tolist()), dtype=float)
                if probs.shape != (len(part), len(names)):
                    raise ValueError(f"scores have shape {probs.shape}, expected {(len(part), len(names))}")
                yield pd.DataFrame(
                    {
                        "entry_id": np.repeat(part["entry_id"].to_numpy(), len(names)),
                        "term": np.tile(names, len(part)),
                        "prob": probs.reshape(-1),
                    }
                )

    kind = df.schema["entry_id"].dataType.simpleString()
    return df.select("entry_id", "sequence").mapInPandas(work, f"entry_id {kind}, term string, prob double")


def ap_udaf(scored: DataFrame, n_entries: int) -> DataFrame:
    """UD04: average precision per term as a grouped aggregate; built-in functions are its only form."""
    return average_precision(scored, n_entries)
