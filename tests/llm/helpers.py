"""Small document tables with all the hard cases."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside.
CLASHING = ["id", "h", "fp", "start", "n", "part", "to", "words", "tokens", "key", "score", "mix_rate", "contaminated_id", "rep", "marks", "html_", "mix_source", "mix_order", "th", "text_key", "row", "name", "count", "law", "every"]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiou") + r.choice("bcdfgklmnprst") for _ in range(r.randint(1, 4))) for _ in range(n))


def first_rows() -> list[tuple]:
    base = words(1, 120)
    return [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, base + " tail end", "en", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \t\n ", None, "b", 3),
        (7, "12 345 !!", "en", "a", 9),
        (8, words(2, 20_000), "en", "a", 1),
        (9, words(3, 60), "de", None, 1),
        (9, words(3, 60), "de", None, 1),
        (None, words(4, 40), "de", "b", 2),
        (-5, words(5, 30) + " " + words(5, 30), "en", "b", 2),
        (10, "été naïve 日本語 \U0001f600 x", "fr", "c", 2),
    ]


def hard_rows() -> list[tuple]:
    """The first rows and others that share an id, a null one too, or hold one very long word."""
    return first_rows() + [
        (None, words(6, 50) + " " + words(6, 50), "de", "b", 2),
        (None, None, "en", "b", None),
        (11, words(1, 40), "en", "b", 2),
        (11, words(7, 45), "en", "b", 2),
        (12, "x" * 300_000, "en", "a", 300_000),
    ]


def hard(spark, extra: bool = True, rows=hard_rows):
    """The rows, with clashing extra columns."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows(), COLUMNS)
    return made.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}) if extra else made


def first_hard(spark):
    return hard(spark, rows=first_rows)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def documents(spark, texts: list, langs: list | None = None, sources: list | None = None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)
