"""Line-first quality rules in DataFrame functions only.

Lines are judged one by one by rules for punctuation, navigation and boilerplate; failing lines go, and
a document that loses too much of its text is rejected. All work is per row: no shuffle, no Python.

A null text has no words and no lines and is rejected; so is an empty one. Repeated rows are judged
alike, an empty table gives an empty result; other columns are ignored, and an existing column of a
result's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_BLANKS = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Phrases of licence, cookie and site texts.
BOILERPLATE = (
    r"all rights reserved|licensed under|released under the|general public license|permission is hereby granted|"
    r"cookie policy|privacy policy|terms of (?:use|service)|copyright (?:\(c\)|©)|this (?:site|website) uses cookies|"
    r"enable javascript|subscribe to our newsletter|powered by"
)
#: Whole short lines that are links of a menu.
NAVIGATION = (
    r"home|menu|search|log ?in|log ?out|sign ?(?:up|in|out)|next|previous|back|top|share|read more|more|contact(?: us)?|"
    r"about(?: us)?|help|faq|sitemap|skip to content"
)


def good_lines(
    lines: Column, boilerplate: str = BOILERPLATE, navigation: str = NAVIGATION, symbol_share: float = 0.1, capital_share: float = 0.6
) -> Column:
    """The lines that pass the punctuation, navigation and boilerplate rules."""

    def count(line, pattern):
        return F.length(F.regexp_replace(line, pattern, ""))

    def describe(x):
        return F.struct(
            x.alias("line"),
            count(x, r"\s+").alias("chars"),
            count(x, r"[^#*$%&|<>{}\\^~=_@!]+").alias("symbols"),
            count(x, r"[^\p{Lu}]+").alias("capitals"),
            count(x, r"\P{L}+").alias("letters"),
        )

    def passes(d):
        punctuation = (d["symbols"] < symbol_share * d["chars"]) & (d["letters"] * 2 >= d["chars"])
        shouted = (d["letters"] >= 12) & (d["capitals"] >= capital_share * d["letters"])
        menu = d["line"].rlike(rf"(?i)^\W*(?:{navigation})\W*$") | d["line"].rlike(r"\s[|>»·•]\s.*\s[|>»·•](?:\s|$)")
        return punctuation & ~shouted & ~menu & ~d["line"].rlike(rf"(?i)\b(?:{boilerplate})")

    return F.transform(F.filter(F.transform(lines, describe), passes), lambda d: d["line"])


def repeated_words(words: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """Hashes of all windows; from them, the words in windows found twice or more.

    Equal windows are found by their 64-bit hashes: sorted with their places, equal hashes are
    neighbours; the places are sorted again and their union is summed.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    last = F.size("_hashes") - window + 1  # named twice, so that it is computed once and not in every step
    wins = F.when(
        last >= 2, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, window)))
    )
    return hashes, wins


def _covered(wins: Column, window: int = WINDOW) -> tuple[Column, Column, Column]:
    pairs = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pair = F.col("_pairs")

    def place(x, k):
        return F.when((F.get(pair, k - 1)["h"] == x["h"]) | (F.get(pair, k + 1)["h"] == x["h"]), x["i"])

    places = F.sort_array(F.array_compact(F.transform(pair, place)))
    spot = F.col("_places")
    parts = F.transform(spot, lambda x, k: F.coalesce(F.least(F.get(spot, k + 1) - x, F.lit(window)), F.lit(window)))
    return pairs, places, F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def clean_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 20,
    most_repeated: int = 30,
    least_kept: float = 0.5,
) -> DataFrame:
    """Counts, verdict and cleaned text of every row.

    ``kept``: enough words, at most ``most_repeated`` percent of them in repeated windows, and good lines
    hold at least ``least_kept`` of the characters in words.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    size = F.col("_words")
    df = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    df = df.select(id_col, text.alias("_text"))
    df = df.select(
        id_col, "_text", F.array_remove(F.split("_text", _BLANKS), "").alias("_words"), F.split("_text", "\n").alias("_lines")
    )
    df = df.withColumn("_lines", F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashes, wins = repeated_words(size)
    df = df.withColumn("_hashes", hashes).withColumn("_wins", wins)
    df = df.withColumn("_twice", F.when(F.size(F.array_distinct("_wins")) < F.size("_wins"), F.col("_wins")))
    pairs, places, covered = _covered(F.col("_twice"))
    df = df.withColumn("_pairs", pairs).withColumn("_places", places)
    df = df.withColumn("_good", good_lines(F.col("_lines")))
    visible = lambda c: F.length(F.regexp_replace(c, _BLANKS, ""))
    df = df.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        visible(F.col("_text")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    df = df.withColumn("kept_chars", visible(F.col("clean_text")).cast("long")).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= least_kept * F.col("word_chars")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")
