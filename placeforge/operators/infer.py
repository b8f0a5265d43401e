"""Filling in missing cities and countries, and merging misspelled city names."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import EARTH_M, haversine

#: Degrees of a cell in which objects share their candidate cities.
CELL = 1.0
#: Width of the finest grid of centroids, and grids, of which the last one's cells are wider than half a great circle.
WIDTH_M, LEVELS = 150_000.0, 9


def has(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def city_centroids(objects: DataFrame, skip_origin: bool = False) -> DataFrame:
    """(city, lat, lon, n) over all objects with a city; ``skip_origin`` leaves out those at (0, 0)."""
    rows = objects.filter(has("city"))
    if skip_origin:
        rows = rows.filter("NOT (lat = 0 AND lon = 0)")
    return rows.groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def city_frequency(objects: DataFrame) -> DataFrame:
    return objects.filter(has("city")).groupBy("city").agg(F.count("*").alias("n"))


def _unit(lat: str, lon: str) -> Column:
    """The point on a sphere of radius 1."""
    p, q = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z"))


def _cell(level: str) -> Column:
    """The cell of the point ``u`` in the grid of a level."""
    scale = EARTH_M / (WIDTH_M * F.pow(F.lit(2.0), F.col(level)))
    return F.struct(*(F.floor(F.col(f"u.{c}") * scale).alias(c) for c in "xyz"))


def _levels(rows: DataFrame) -> DataFrame:
    """Rows once for each grid, with its level and the cell of ``u``."""
    return rows.withColumn("level", F.explode(F.array(*map(F.lit, range(LEVELS))))).withColumn("cell", _cell("level"))


def _around(rows: DataFrame) -> DataFrame:
    """Rows with their column ``cell`` and again with each of the 26 cells that touch it."""
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in product((-1, 0, 1), repeat=3)))
    moved = F.struct(*((F.col(f"cell.{c}") + F.col(f"step.{c}")).alias(c) for c in "xyz"))
    return rows.withColumn("step", F.explode(steps)).withColumn("cell", moved).drop("step")


def nearest(objects: DataFrame, centroids: DataFrame, out: str = "nearest", digits: int = 0) -> DataFrame:
    """``objects`` with the city of the nearest centroid; equal distances (rounded to ``digits``) go to the smaller name.

    Objects of one cell share candidates: by the triangle inequality, a centroid farther from the
    cell's middle than any other by over twice the cell's radius can't be nearest to anything in the
    cell.  Cells (64 800 at most) meet centroids by equi-joins on cubic grids through the sphere, each
    twice as wide as the one before: one centroid of each grid cell tells how far away the nearest one
    is at most, and the finest grid whose cells are that wide gives the candidates.
    """
    row = lambda c: F.floor(c / CELL)
    cell = objects.filter("lat IS NOT NULL AND lon IS NOT NULL").select(row(F.col("lat")).alias("cy"), row(F.col("lon")).alias("cx")).distinct()
    middle = cell.withColumns({"my": (F.col("cy") + 0.5) * CELL, "mx": (F.col("cx") + 0.5) * CELL})
    laid = _around(_levels(middle.withColumn("u", _unit("my", "mx"))))
    cities = centroids.filter("lat IS NOT NULL AND lon IS NOT NULL").select("city", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    dealt = _levels(cities.withColumn("u", _unit("clat", "clon"))).drop("u")
    to_city = haversine(F.col("my"), F.col("mx"), F.col("clat"), F.col("clon"))
    one = dealt.groupBy("level", "cell").agg(F.min(F.struct("clat", "clon")).alias("c")).select("level", "cell", "c.*")
    reach = laid.join(one, ["level", "cell"]).groupBy("cy", "cx").agg(F.min(to_city).alias("least"), F.first("my").alias("my"), F.first("mx").alias("mx"), F.first("u").alias("u"))
    # a cell is nowhere wider than at the equator; a chord is shorter than its arc
    radius = EARTH_M * 3.15 / 180 * CELL * 0.7072
    reach = reach.withColumn("reach", F.col("least") + 2 * radius + 1)
    wide = F.greatest(F.lit(0), F.ceil(F.log2(F.col("reach") / WIDTH_M))).cast("int")
    search = _around(reach.withColumn("level", wide).withColumn("cell", _cell("level")).drop("u", "least"))
    near = search.join(dealt, ["level", "cell"]).filter(to_city <= F.col("reach"))
    lists = near.groupBy("cy", "cx").agg(F.collect_list(F.struct("city", "clat", "clon")).alias("cities"))
    joined = objects.join(lists, (row(F.col("lat")) == F.col("cy")) & (row(F.col("lon")) == F.col("cx")), "left")
    best = F.array_min(F.transform("cities", lambda c: F.struct(F.round(haversine(F.col("lat"), F.col("lon"), c["clat"], c["clon"]), digits).alias("d"), c["city"].alias("city"))))
    return joined.withColumn(out, best["city"]).withColumn(out + "_m", best["d"]).drop("cy", "cx", "cities")


def fill_cities(objects: DataFrame, skip_origin: bool = False) -> DataFrame:
    """Objects without a city get the nearest one."""
    found = nearest(objects.filter(~has("city") | F.col("city").isNull()), city_centroids(objects, skip_origin))
    filled = found.withColumn("city", F.coalesce("nearest", "city")).drop("nearest", "nearest_m")
    return objects.filter(has("city")).unionByName(filled)


def typo_replacements(frequency: DataFrame) -> DataFrame:
    """(city, canonical, distance): a city whose name is one edit (two from six bytes on) from one over twice as frequent.

    Of several the most frequent wins, then the smaller name.  Replacement isn't transitive.  Names
    within two edits share a form with up to two letters deleted, so candidates come from an equi-join.
    """
    keyed = frequency.select("city", "n", F.explode(text.deletes(F.col("city"))).alias("form"))
    other = keyed.select(F.col("city").alias("canonical"), F.col("n").alias("m"), "form")
    pairs = keyed.join(other, "form").filter("2 * n < m").select("city", "n", "canonical", "m").distinct()
    near = pairs.withColumn("distance", F.levenshtein("city", "canonical"))
    near = near.filter((F.col("distance") == 1) | (F.col("distance") == 2) & (F.octet_length("city") >= 6))
    best = F.min(F.struct((-F.col("m")).alias("f"), "canonical", "distance"))
    return near.groupBy("city").agg(best.alias("b")).select("city", "b.canonical", "b.distance")


def merge_typos(objects: DataFrame) -> DataFrame:
    fixes = typo_replacements(city_frequency(objects)).select(F.col("city").alias("typo"), "canonical")
    joined = objects.join(fixes, F.col("city") == F.col("typo"), "left")
    return joined.withColumn("city", F.coalesce("canonical", "city")).drop("typo", "canonical")


def city_countries(objects: DataFrame) -> DataFrame:
    """(city, country): the first country by seq among objects with both."""
    return objects.filter(has("city") & has("country")).groupBy("city").agg(F.min_by("country", "seq").alias("country"))


def fill_countries(objects: DataFrame, region: str | None = None) -> DataFrame:
    """Objects without a country get their city's, else the region's."""
    known = city_countries(objects).toDF("known_city", "known_country")
    joined = objects.join(known, F.col("city") == F.col("known_city"), "left")
    missing = F.coalesce(F.col("known_country"), F.lit(text.region_country(region)), F.col("country"))
    return joined.withColumn("country", F.when(has("country"), F.col("country")).otherwise(missing)).drop("known_city", "known_country")
