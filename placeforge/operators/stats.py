"""Reports over objects: counts, histograms, and tops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def object_counts(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("*").alias("objects"), F.count_if(F.col("type") == 0).alias("addresses"), F.count_if(F.col("type") == 1).alias("named"))


def category_histogram(points: DataFrame) -> DataFrame:
    counted = points.groupBy("category").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))  # over categories
    return counted.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(whole), 4))


def top_cities(addresses: DataFrame, limit: int = 30) -> DataFrame:
    """Cities by their number of addresses; the empty ones are one city."""
    city = F.when(F.coalesce("city", F.lit("")) == "", "(пусто)").otherwise(F.col("city"))
    return addresses.groupBy(city.alias("city")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(limit)


def city_streets(addresses: DataFrame, limit: int = 15) -> DataFrame:
    """Cities by addresses, with their number of streets."""
    return addresses.filter("city <> ''").groupBy("city").agg(F.count("*").alias("n_addresses"), F.count_distinct("street").alias("n_streets")).orderBy(F.desc("n_addresses"), "city").limit(limit)


def street_houses(addresses: DataFrame, limit: int = 10) -> DataFrame:
    return addresses.filter("street <> ''").groupBy("city", "street").agg(F.count("*").alias("n_houses")).orderBy(F.desc("n_houses"), "city", "street").limit(limit)


def points_named_as_cities(points: DataFrame, addresses: DataFrame) -> DataFrame:
    cities = addresses.select(F.col("city").alias("as_city")).filter("as_city IS NOT NULL").distinct()
    return points.join(cities, F.col("name") == F.col("as_city"), "left_semi")


def inspect_city(addresses: DataFrame, city: str, samples: int = 5) -> tuple[int, DataFrame]:
    rows = addresses.filter(F.lower("city") == city.lower())
    return rows.count(), rows.orderBy("seq").limit(samples)


def upsert_meta(*tables: DataFrame) -> DataFrame:
    """(key, value) of which later tables win, sorted by key."""
    every = None
    for k, t in enumerate(tables):
        part = t.select("key", "value", F.lit(k).alias("turn"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("key").agg(F.max_by("value", "turn").alias("value")).orderBy("key")


def match_report(cases: DataFrame, expected: str = "output", found: str = "found") -> DataFrame:
    """Exact matches by category, and over all (category null)."""
    ok = (F.col(expected) == F.col(found)).cast("int")
    return cases.withColumn("ok", ok).rollup("category").agg(F.count("*").alias("n"), F.sum("ok").alias("matches"), F.round(F.avg("ok"), 6).alias("rate"))


def character_accuracy(cases: DataFrame, expected: str = "output", found: str = "found") -> DataFrame:
    """Characters equal in place, over the longer lengths."""
    a, b = (F.split(F.col(c), "") for c in (expected, found))
    same = F.size(F.filter(F.zip_with(F.when(F.length(expected) > 0, a).otherwise(F.array().cast("array<string>")), F.when(F.length(found) > 0, b).otherwise(F.array().cast("array<string>")), lambda x, y: x.eqNullSafe(y) & x.isNotNull()), lambda e: e))
    return cases.agg(F.round(F.sum(same) / F.sum(F.greatest(F.length(expected), F.length(found))), 6).alias("accuracy"))


def precision_at_1(answers: DataFrame) -> DataFrame:
    """Of (query, rank, id, wanted): the share of queries of which the best hit is the wanted one."""
    best = answers.groupBy("query").agg(F.min_by("id", F.struct("rank", "id")).alias("id"), F.first("wanted").alias("wanted"))
    return best.agg(F.avg((F.col("id") == F.col("wanted")).cast("int")).alias("precision_at_1"))
