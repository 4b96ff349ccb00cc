"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the sources, by code point with null last, take the given weights in turn and share
``budget`` times all words; a target stops at ``ceiling`` times its source's words, and what is above is
shared anew by weight. With the sources by words per weight that is one running total: a source is
capped if its ceiling is at most its share of what the sources before it leave.

Blocks: the documents of a source, in an order drawn by md5 of id, epoch and seed, are one stream of words; a
further epoch is drawn anew. The stream is cut into blocks of ``block_words`` and ends at the target.

Schedule: block counts are laid end to end on the points ``0 .. N - 1``, and point ``j`` is visited at
its van der Corput place (its bits in reverse). All N points are visited once, so every source gets
exactly its blocks, and any stretch of the schedule holds the sources in nearly the shares of their
targets. An interval of points is a few dyadic ones, and the places of a dyadic one are an arithmetic
progression; so slots are listed, and ranked within their source, without a sort, and the block with
that number in the source's stream is joined.

A null text, or one without words, has size 0 and is never taken; a null source is a source of its own; rows
without id and repeated rows are documents of their own (equal rows take the same words in some order);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import global_rank, running_totals
from .common import save, table

WEIGHTS = (5, 2, 1)
#: Words of all targets and most words of one target, as halves of the words there are (150 % and 2 times).
BUDGET, CEILING = 3, 4
BLOCK_WORDS = 1024
SEED = 17
#: Slots that one row stands for until the schedule is dealt out.
_RUN = 4096


class Mixture(NamedTuple):
    """``documents``: row, id, source, size [, text]; ``targets``: one row a source; ``pieces``: see :func:`mix`."""

    documents: DataFrame
    targets: DataFrame
    pieces: DataFrame


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: int = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """(place, source, source_size, target, take) of a table (source, size); ``take`` is the target in whole words."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = save(sums.withColumn("_line", F.struct(F.col("source").isNull(), "source")), "sources")
    ranked = global_rank(sums, "source", "_line", out="place").withColumn("place", F.col("place") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("place", "source", "source_size", weight.alias("weight"))
    filled = ranked.withColumn("_turn", F.struct(F.col("source_size") / F.col("weight"), "place"))
    filled = running_totals(filled, [], "_turn", {"source_size": "_words", "weight": "_weights"}, descending=False)
    filled = save(filled, "filled")
    total = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    words, shares = total[0] or 0, total[1] or 0

    def big(c: Column) -> Column:  # products of words and weights pass 64 bits
        return c.cast("decimal(19,0)")

    left = F.lit(budget * words) - ceiling * (F.col("_words") - F.col("source_size"))
    others = F.lit(shares) - (F.col("_weights") - F.col("weight"))
    capped = big(ceiling * F.col("source_size")) * big(others) <= big(left) * big(F.col("weight"))
    filled = filled.withColumn("_capped", capped)
    most = filled.agg(
        F.sum(F.when(F.col("_capped"), F.col("source_size"))), F.sum(F.when(~F.col("_capped"), F.col("weight")))
    ).first()
    rest, parts = budget * words - ceiling * (most[0] or 0), most[1] or 1
    share = big(F.lit(rest)) * big(F.col("weight"))
    exact = F.when(F.col("_capped"), (ceiling * F.col("source_size")).cast("double") / 2)
    whole = F.when(F.col("_capped"), F.floor(ceiling * F.col("source_size") / 2))
    return save(
        filled.select(
            "place",
            "source",
            "source_size",
            F.coalesce(exact, share.cast("double") / F.lit(2.0 * parts)).alias("target"),
            F.coalesce(whole, F.floor(share / big(F.lit(2 * parts)))).cast("long").alias("take"),
        ),
        "targets",
    )


def _reverse(value: Column, bits: Column) -> Column:
    """The last ``bits`` bits of a number in reverse."""
    turned = F.conv(F.reverse(F.lpad(F.bin(value), bits, F.lit("0"))), 2, 10).cast("long")
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(turned)


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(place, block, slot): the slot of every block of every source; slots are distinct, not dense."""
    counts = targets.withColumn("_n", F.ceil(F.col("take") / block_words).cast("long")).filter("_n > 0").select("place", "_n")
    points = counts.agg(F.sum("_n")).first()[0] or 1
    bits = max(1, int(points - 1).bit_length())
    ends = running_totals(counts, [], "place", {"_n": "_end"}, descending=False)
    levels = ends.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("width", F.expr("shiftleft(1L, b)"))
    first, last = F.expr("(_end - _n + width - 1) div width"), F.expr("_end div width")
    levels = levels.withColumns({"_from": first, "_to": last}).filter("_from < _to")
    # Dyadic intervals of this width that the next wider ones do not hold: one at either end at most.
    m = F.explode(
        F.array_compact(
            F.array(F.when(F.col("_from") % 2 == 1, F.col("_from")), F.when(F.col("_to") % 2 == 1, F.col("_to") - 1))
        )
    )
    high = (F.lit(bits) - F.col("b")).cast("int")
    lines = levels.withColumn("m", m).select(
        "place", _reverse(F.col("m"), high).alias("first"), F.expr(f"shiftleft(1L, {bits} - b)").alias("step"), F.col("width").alias("count")
    )
    lines = lines.groupBy("place").agg(F.collect_list(F.struct("first", "step", "count")).alias("lines"))
    runs = lines.select("place", "lines", F.explode("lines").alias("own"))
    runs = runs.withColumn("run", F.explode(F.expr(f"sequence(0L, (own.count - 1) div {_RUN})"))).repartition("place", "own.first", "run")
    inside = F.expr(f"sequence(run * {_RUN}, least((run + 1) * {_RUN}, own.count) - 1)")
    slots = runs.withColumn("x", F.explode(inside)).withColumn("slot", F.expr("own.first + x * own.step"))

    def earlier(line: Column) -> Column:
        reached = F.floor((F.col("slot") - line["first"] + line["step"] - 1) / line["step"])
        return F.greatest(F.lit(0).cast("long"), F.least(line["count"], reached))

    rank = F.aggregate("lines", F.lit(0).cast("long"), lambda total, line: total + earlier(line))
    return slots.select("place", rank.alias("block"), "slot")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: int = BUDGET,
    ceiling: int = CEILING,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    texts: bool = False,
) -> Mixture:
    """The mixture as pieces (slot, at, row, id, place, epoch, start, length): in the order of (slot, at)
    they are the mixed stream; ``start`` and ``length`` count words of the document."""
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    columns = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("like")]
    documents = docs.select(F.monotonically_increasing_id().alias("row"), *columns, *([text.alias("text")] if texts else []))
    documents = save(documents, "sizes")
    targets = source_targets(documents, weights, budget, ceiling)
    named = targets.select("place", F.col("source").alias("_source"), "source_size", "take")
    narrow = documents.filter("size > 0").select("row", "id", "like", "size", "source")
    epochs = F.expr("sequence(0L, (take - 1) div source_size)")
    copies = narrow.join(named.filter("take > 0"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("epoch", F.explode(epochs))
    drawn = F.md5(F.concat_ws("|", F.col("id"), F.col("epoch"), F.lit(seed)))
    copies = copies.select("place", "row", "id", "size", "take", F.struct("epoch", drawn.alias("drawn"), "like", "row").alias("turn"))
    stream = running_totals(copies, ["place"], "turn", {"size": "_upto"}, descending=False)
    stream = stream.withColumns({"_at": F.expr("_upto - size"), "_end": F.least("_upto", "take")}).filter("_at < _end")
    block = F.explode(F.expr(f"sequence(_at div {block_words}, (_end - 1) div {block_words})"))
    cut = stream.withColumn("block", block).withColumns(
        {"_a": F.greatest("_at", F.col("block") * block_words), "_b": F.least("_end", (F.col("block") + 1) * block_words)}
    )
    cut = cut.select(
        "place",
        "block",
        "row",
        "id",
        F.col("turn.epoch").alias("epoch"),
        (F.col("_a") - F.col("_at")).alias("start"),
        (F.col("_b") - F.col("_a")).alias("length"),
        (F.col("_a") - F.col("block") * block_words).alias("at"),
    )
    # Written, as Spark takes exploded rows for few and would broadcast them.
    pieces = cut.join(save(schedule(targets, block_words), "slots"), ["place", "block"])
    pieces = pieces.select("slot", "at", "row", "id", "place", "epoch", "start", "length")
    return Mixture(documents, targets, save(pieces, "pieces"))


def mixed_texts(mixture: Mixture) -> DataFrame:
    """(slot, at, id, text): the words of each piece, of a mixture made with ``texts=True``."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    own = mixture.documents.select("row", words.alias("_words"))
    piece = F.concat_ws(" ", F.slice("_words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")))
    return mixture.pieces.join(own, "row").select("slot", "at", "id", piece.alias("text"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mix(table(spark, sf_dir, "documents"))
    taken = mixture.pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    sources = mixture.targets.select(F.col("source").alias("_source"), "source_size", "target")
    rows = mixture.documents.join(taken, "row", "left").join(sources, F.col("source").eqNullSafe(F.col("_source")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
