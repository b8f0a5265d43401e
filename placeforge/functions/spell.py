"""Dictionary-based spelling repair by symmetric deletion.

Dictionary terms and query words within two edits share a form with up to two characters deleted, so
candidates come from an equi-join on those forms, over distinct words only.  Candidates are measured
by optimal string alignment distance (swaps of neighbours count one); the nearest wins, then the more
frequent, then the smaller.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import text as T


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most + 1:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


@F.pandas_udf(IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)])


def suggestions(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, term, distance): the best dictionary term of each distinct word that has one within ``most``."""
    asked = words.select("word").distinct()
    known = dictionary.filter("term IS NOT NULL").groupBy("term").agg(F.max("freq").alias("freq"))
    left = asked.select("word", F.explode(T.deletes(F.col("word"), most)).alias("form"))
    right = known.select("term", "freq", F.explode(T.deletes(F.col("term"), most)).alias("form"))
    pairs = left.join(right, "form").filter(F.abs(F.length("word") - F.length("term")) <= most).select("word", "term", "freq").distinct()
    # a swap costs the built-in distance two edits, so what is within ``most`` here is within twice that there
    pairs = pairs.filter(F.levenshtein("word", "term", 2 * most) >= 0)
    near = pairs.withColumn("distance", osa_udf("word", "term")).filter(F.col("distance") <= most)
    best = F.min(F.struct("distance", (-F.col("freq")).alias("f"), "term"))
    return near.groupBy("word").agg(best.alias("b")).select("word", "b.term", "b.distance")


def correct(rows: DataFrame, column: str, dictionary: DataFrame, key: str = "seq") -> DataFrame:
    """``rows`` with the words of ``column`` repaired; ``key`` names the rows.

    Words of three bytes or less, without Cyrillic letters, or protected stay.  White space collapses.
    """
    word, low = F.col("w"), F.lower("w")
    split = rows.select(key, F.posexplode(T.words(F.col(column))).alias("at", "w")).withColumn("low", low)
    open_ = split.filter((F.octet_length(word) > 3) & T.contains_cyrillic(word) & ~T.is_protected_word(F.col("low")))
    found = suggestions(open_.select(F.col("low").alias("word")), dictionary)
    hits = open_.join(found, open_.low == found.word).filter("term <> low").select(key, F.struct("at", T.restore_case(F.col("term"), word).alias("to")).alias("fix"))
    fixes = hits.groupBy(F.col(key).alias("fix_key")).agg(F.map_from_entries(F.collect_list("fix")).alias("fixes"))
    joined = rows.join(fixes, F.col(key) == F.col("fix_key"), "left")
    repaired = F.transform(T.words(F.col(column)), lambda w, i: F.coalesce(F.try_element_at(F.col("fixes"), i), w))
    return joined.withColumn(column, F.when(F.col(column) == "", "").otherwise(F.array_join(repaired, " "))).drop("fix_key", "fixes")
