"""Labels, vocabularies and frequencies (AG01-AG07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written
from .order import global_rank

TASK_TEXT = 1 << 28  # bytes of label texts that a task makes
SHARED_TEXT = 1 << 19  # bytes of different texts in a task whose texts repeat; a Parquet dictionary holds twice as many
SHARED_TASKS = 1 << 14  # such tasks at most

def terms_per_entry(df: DataFrame, by_aspect: bool = False) -> DataFrame:
    """AG01: sorted distinct terms per entry with their multiplicities (``counts``, same order).

    Repeated annotations are counted before the list is built, so a list is never longer than the
    vocabulary however many rows one entry has.
    """
    keys = ["entry_id", "aspect"] if by_aspect else ["entry_id"]
    counted = df.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("_t"))
    return packed.select(*keys, F.col("_t.term").alias("terms"), F.col("_t.n").alias("counts"))


def term_frequency(df: DataFrame, by_aspect: bool = True) -> DataFrame:
    """AG02: occurrences per term (duplicates count), per aspect or global."""
    keys = ["aspect", "term"] if by_aspect else ["term"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame) -> DataFrame:
    """AG03: distinct terms per aspect in sorted order with a zero-based index, ranked in range partitions."""
    ranked = global_rank(df.select("aspect", "term").distinct(), "term", value="term", keys=["aspect"], out="_r")
    return ranked.select("aspect", "term", (F.col("_r") - 1).alias("idx"))


def label_indices(df: DataFrame, vocab: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """AG04, as it is kept and joined: ``entry_id, size, indices`` over a vocabulary of ``term, idx`` (one aspect).

    ``indices`` are the sorted positions of an entry's terms, so a row is as long as the entry has terms
    and not as the vocabulary; :func:`dense_labels` and :func:`label_text` decode it where a sink needs all places.
    The written vocabulary meets the annotations first, so these are shuffled once, as one row for each entry of a task.
    """
    vocab = written(vocab.select("term", "idx"), "label-vocabulary")
    size = vocab.agg(F.count(F.lit(1))).scalar()
    known = F.when(F.col("entry_id").isNotNull(), F.col("idx"))  # a NULL entry has no labels
    marked = df.select("entry_id", "term").join(vocab, "term", "left")
    sets = marked.groupBy("entry_id").agg(F.sort_array(F.collect_set(known)).alias("_on"))
    if entries is not None:
        sets = entries.select("entry_id").distinct().join(sets, "entry_id", "left")
    return sets.select(
        "entry_id", size.cast("int").alias("size"), F.coalesce("_on", F.array().cast("array<bigint>")).alias("indices")
    )


def _zeros_between(indices: Column) -> tuple[Column, Column]:
    """Zeros before each index, and behind the last one."""
    gaps = F.transform(indices, lambda x, i: (x - F.coalesce(F.get(indices, i - 1), F.lit(-1)) - 1).cast("int"))
    return gaps, F.col("size") - 1 - F.coalesce(F.get(indices, F.size(indices) - 1), F.lit(-1)).cast("int")


def side_by_side(sparse: DataFrame) -> DataFrame:
    """Rows of :func:`label_indices` dealt so that equal labels share a task, and a task has few different ones.

    A columnar sink then keeps a text once in each file, not once for each entry. Labels of very many entries are dealt
    to several tasks; those of one entry alone go by themselves, as nothing can be shared there.
    """
    sparse = written(sparse, "label-indices")
    counts = written(sparse.groupBy("size", "indices").agg(F.count(F.lit(1)).alias("_n"), F.min("entry_id").alias("entry_id")), "label-sets")
    several = F.col("_n") > 1
    many, rows, single, width = counts.agg(
        F.count_if(several), F.coalesce(F.sum(F.when(several, F.col("_n"))), F.lit(0)), F.count_if(~several), F.coalesce(F.max("size"), F.lit(0))
    ).first()
    tasks = lambda n, most: max(1, -(-n * width // most))
    shared = max(tasks(rows, TASK_TEXT), min(SHARED_TASKS, tasks(many, SHARED_TEXT)))
    some = F.ceil(F.col("_n") * F.col("size") / F.lit(float(TASK_TEXT)))
    salt = F.pmod(F.xxhash64("entry_id"), F.greatest(some, F.lit(1)))
    held = sparse.join(counts.filter(several).drop("entry_id"), ["size", "indices"]).withColumn("_salt", salt)
    held = held.repartition(shared, "indices", "_salt")
    alone = counts.filter(~several).repartition(tasks(single, TASK_TEXT), "indices")
    return held.select(*sparse.columns).unionByName(alone.select(*sparse.columns))


def label_text(sparse: DataFrame) -> DataFrame:
    """Labels of :func:`label_indices` as one text of 0 and 1 per entry."""
    gaps, tail = _zeros_between(F.col("indices"))
    ones = F.array_join(F.transform(gaps, lambda n: F.concat(F.repeat(F.lit("0"), n), F.lit("1"))), "")
    return sparse.select("entry_id", F.concat(ones, F.repeat(F.lit("0"), tail)).alias("labels"))


def dense_labels(sparse: DataFrame) -> DataFrame:
    """Labels of :func:`label_indices` as one 0/1 array per entry."""
    gaps, tail = _zeros_between(F.col("indices"))
    zero = F.lit(0)
    runs = F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(zero, n), F.array(F.lit(1)))))
    return sparse.select("entry_id", F.concat(runs, F.array_repeat(zero, tail)).alias("labels"))


def multi_hot(df: DataFrame, vocab: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """AG04 at the sink: 0/1 array per entry over a vocabulary of ``term, idx`` (one aspect)."""
    return dense_labels(label_indices(df, vocab, entries))


def stratum_key(df: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """AG05: sorted distinct aspects of an entry joined to a string; ``NA`` when it has none."""
    keys = df.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("aspect")), "").alias("stratum"))
    if entries is not None:
        keys = entries.select("entry_id").distinct().join(keys, "entry_id", "left")
    return keys.select("entry_id", F.coalesce(F.nullif("stratum", F.lit("")), F.lit("NA")).alias("stratum"))


def stratum_counts(df: DataFrame) -> DataFrame:
    """AG06: entries and share of the whole per stratum."""
    counts = df.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("stratum", "n", (F.col("n") / total).alias("share"))


def frequency_score(df: DataFrame, freq: DataFrame, entries: DataFrame) -> DataFrame:
    """AG07: mean of ``ln(1 + freq)`` over an entry's terms; unseen terms count 0, no terms give 0.

    Annotations are counted per (entry, term) first, so duplicates weigh as in a plain mean while
    the join carries one row per pair.
    """
    counted = df.groupBy("entry_id", "term").agg(F.count(F.lit(1)).alias("_c"))
    weighed = counted.join(freq.select("term", F.col("n").alias("_f")), "term", "left").withColumn(
        "_w", F.log1p(F.coalesce(F.col("_f"), F.lit(0)).cast("double"))
    )
    means = weighed.groupBy("entry_id").agg((F.sum(F.col("_c") * F.col("_w")) / F.sum("_c")).alias("_s"))
    return entries.select("entry_id").distinct().join(means, "entry_id", "left").select(
        "entry_id", F.coalesce("_s", F.lit(0.0)).alias("score")
    )
