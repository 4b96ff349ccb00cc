"""String column functions (PF01-PF06, PF10, PF15, PF17, PF20)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aspect aliases accepted by the annotation reader.
ASPECT_ALIASES = {
    "C": "C", "CC": "C", "CCO": "C", "CELLULARCOMPONENT": "C",
    "F": "F", "MF": "F", "MFO": "F", "MOLECULARFUNCTION": "F", "M": "F",
    "P": "P", "BP": "P", "BPO": "P", "BIOLOGICALPROCESS": "P", "B": "P",
}
# The smaller alias set of the slice builder.
SLICE_ALIASES = {
    "C": "C", "CC": "C", "CELLULARCOMPONENT": "C",
    "F": "F", "MF": "F", "MOLECULARFUNCTION": "F",
    "P": "P", "BP": "P", "BIOLOGICALPROCESS": "P",
}
# One-letter aspect codes and their two-letter names.
ASPECT_NAMES = {"F": "MF", "P": "BP", "C": "CC"}
# The 20 standard residues.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def normalise_aspect(col: Column) -> Column:
    """PF01: letters only, upper case, alias table; unknown values stay as they are."""
    key = F.upper(F.regexp_replace(col, "[^A-Za-z]", ""))
    return F.coalesce(_lookup(ASPECT_ALIASES, key), col)


def normalise_aspect_letter(col: Column) -> Column:
    """PF02: trim + upper, smaller alias table; unknown values keep their first letter."""
    key = F.upper(F.trim(col))
    return F.coalesce(_lookup(SLICE_ALIASES, key), F.substring(key, 1, 1))


def aspect_name(col: Column) -> Column:
    """PF03: F/P/C to MF/BP/CC, unknown kept."""
    return F.coalesce(_lookup(ASPECT_NAMES, col), col)


def aspect_code(col: Column) -> Column:
    """PF03, the other direction: MF/BP/CC to F/P/C, unknown kept."""
    return F.coalesce(_lookup({name: code for code, name in ASPECT_NAMES.items()}, col), col)


def clean_sequence(col: Column) -> Column:
    """PF04: trim, upper, everything outside the 20 residues becomes X."""
    return F.regexp_replace(F.upper(F.trim(col)), f"[^{RESIDUES}]", "X")


def space_residues(col: Column, prefix: str = "<AA2fold>") -> Column:
    """PF05: rare residues U, Z, O, B become X; residues separated by blanks after a prefix."""
    masked = F.regexp_replace(col, "[UZOB]", "X")
    return F.concat(F.lit(prefix + " "), F.regexp_replace(masked, "(?<=.)(?=.)", " "))


def artefact_key(col: Column) -> Column:
    """PF06: file-safe id followed by the first 8 hex digits of its md5."""
    safe = F.regexp_replace(col, "[^A-Za-z0-9_-]", "_")
    safe = F.when(F.length(safe) == 0, F.lit("protein")).otherwise(safe)
    return F.concat(safe, F.lit("_"), F.substring(F.md5(col), 1, 8))


def partition_path(template: str, aspect: Column) -> Column:
    """PF15: fill ``{aspect}`` and ``{aspect_lower}`` in a path template."""
    out = F.replace(F.lit(template), F.lit("{aspect_lower}"), F.lower(aspect))
    return F.replace(out, F.lit("{aspect}"), aspect)


def bind(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``, so nested uses do not copy its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def score_text(col: Column) -> Column:
    """PF10: three significant digits without trailing zeros; null when not finite or not positive.

    Rounding is that of the exact binary value (half to even), so it agrees with ``%.3g``: the
    rounding error of ``x * 10^m`` is recovered with a two-product and settles apparent ties.
    """

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    def rounded(x: Column, e: Column) -> Column:
        def with_scale(s: Column) -> Column:
            xh, xl = halves(x)
            sh, sl = halves(s)

            def with_product(p: Column) -> Column:
                error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
                whole = F.floor(p)
                rest = (p - whole) - 0.5
                odd = F.pmod(whole, F.lit(2)) == 1
                up = (rest > 0) | ((rest == 0) & ((error > 0) | ((error == 0) & odd)))
                return whole + F.when(up, 1).otherwise(0)

            return bind(x * s, with_product)

        return bind(F.pow(F.lit(10.0), 2 - e), with_scale)

    def text_of(e: Column, digits: Column) -> Column:
        tail = F.regexp_replace(F.substring(digits, 2, 2), "0+$", "")
        zeros = F.repeat(F.lit("0"), (-e - 1).cast("int"))
        fixed = F.concat(F.lit("0."), zeros, F.regexp_replace(digits, "0+$", ""))
        point = F.when(tail == "", F.lit("")).otherwise(F.lit("."))
        pad = F.when(-e < 10, F.lit("0")).otherwise(F.lit(""))
        scientific = F.concat(F.substring(digits, 1, 1), point, tail, F.lit("e-"), pad, (-e).cast("string"))
        return F.when(e >= 0, F.lit("1")).when(e >= -4, fixed).otherwise(scientific)

    def with_exponent(x: Column, guess: Column) -> Column:
        # log10 may be off by one next to a power of ten
        e = F.when(F.pow(F.lit(10.0), guess + 1) <= x, guess + 1).when(F.pow(F.lit(10.0), guess) > x, guess - 1)
        return bind(
            F.coalesce(e, guess),
            lambda e: bind(
                rounded(x, e),
                lambda k: text_of(
                    F.when(k >= 1000, e + 1).otherwise(e), F.when(k >= 1000, F.lit("100")).otherwise(k.cast("string"))
                ),
            ),
        )

    value = col.cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    capped = F.least(value, F.lit(1.0))
    return F.when(usable, bind(capped, lambda x: bind(F.floor(F.log10(x)), lambda g: with_exponent(x, g))))


def chunk_sequence(df: DataFrame, k: int, col: str = "sequence") -> DataFrame:
    """PF17: pieces of at most ``k`` residues; an empty sequence gives no piece."""
    pieces = F.regexp_extract_all(F.col(col), F.lit(f"(?s).{{1,{k}}}"), F.lit(0))
    return df.select("entry_id", F.posexplode(pieces).alias("chunk_no", "chunk"))


def gram_text(col: Column) -> Column:
    """What n-grams are taken from: lower case, white space as one blank."""
    return F.lower(F.regexp_replace(col, r"\s+", " "))


def gram_array(col: Column, n: int = 3) -> Column:
    """All overlapping lower-cased character n-grams of a text, in order, duplicates kept.

    One look-ahead scan is linear in the text; ``substring(s, i, n)`` per position is quadratic.
    """
    return F.regexp_extract_all(gram_text(col), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def ngrams(df: DataFrame, n: int = 3, col: str = "sequence") -> DataFrame:
    """PF20: one row per n-gram occurrence."""
    return df.select("entry_id", F.explode(gram_array(F.col(col), n)).alias("gram"))
