import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (id, text) or (id, text, lang); a column clashes with results."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({"spans": F.lit(1), "kept": F.lit("x"), "start": F.lit(2), "block": F.lit(None).cast("int")})
        return df

    return make


@pytest.fixture
def prose():
    """Seeded sentences of invented words."""
    import random

    def make(seed, words, vocabulary=400):
        rng = random.Random(seed)
        parts = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]
        known = [random.Random(i).choice(parts) + random.Random(i + 1).choice(parts) for i in range(vocabulary)]
        return " ".join(rng.choice(known) + ("." if rng.random() < 0.1 else "") for _ in range(words)) + "."

    return make
