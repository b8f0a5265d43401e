"""From raw map elements to addresses and points of interest.

An element has seq, kind (node, way, relation), id, lat, lon, tags, refs (of a way) and members (of a
relation).  Coordinates of ways and relations come from joins; what finds no coordinate is at (0, 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

ELEMENTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("refs", T.ArrayType(T.LongType())),
    T.StructField("members", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType())]))),
])

OBJECTS = ["seq", "type", "lat", "lon", "country", "city", "street", "housenumber", "postcode", "name", "category"]


def centroids(refs: DataFrame, points: DataFrame) -> DataFrame:
    """Means of the points that the references find: refs (owner, type, ref), points (type, ref, lat, lon).

    A reference that comes twice counts twice.
    """
    found = refs.join(points, ["type", "ref"])
    return found.groupBy("owner").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def node_points(elements: DataFrame) -> DataFrame:
    return elements.filter("kind = 'node'").select(F.lit("node").alias("type"), F.col("id").alias("ref"), "lat", "lon")


def way_centroids(elements: DataFrame) -> DataFrame:
    """(owner, lat, lon) of every way; (0, 0) if none of its nodes is known."""
    ways = elements.filter("kind = 'way'").select(F.col("id").alias("owner"), "refs")
    refs = ways.select("owner", F.lit("node").alias("type"), F.explode("refs").alias("ref"))
    found = centroids(refs, node_points(elements))
    return ways.select("owner").join(found, "owner", "left").fillna(0.0, ["lat", "lon"])


def relation_centroids(elements: DataFrame, ways: DataFrame) -> DataFrame:
    """(owner, lat, lon) of every relation from its nodes and the centroids of its ways; ways at (0, 0) are unknown."""
    relations = elements.filter("kind = 'relation'").select(F.col("id").alias("owner"), "members")
    refs = relations.select("owner", F.explode("members").alias("m")).select("owner", "m.type", "m.ref").filter("type IN ('node', 'way')")
    known = ways.filter("NOT (lat = 0 AND lon = 0)").select(F.lit("way").alias("type"), F.col("owner").alias("ref"), "lat", "lon")
    found = centroids(refs, node_points(elements).unionByName(known))
    return relations.select("owner").join(found, "owner", "left").fillna(0.0, ["lat", "lon"])


def located(elements: DataFrame) -> DataFrame:
    """Elements with coordinates for every kind."""
    from ..plans.build import save

    ways = save(way_centroids(elements))  # the relations need them too
    relations = relation_centroids(elements, ways)
    places = ways.withColumn("kind", F.lit("way")).unionByName(relations.withColumn("kind", F.lit("relation"))).withColumnsRenamed({"owner": "id", "lat": "at_lat", "lon": "at_lon"})
    nodes = elements.filter("kind = 'node'").select("seq", "kind", "id", "lat", "lon", "tags")
    rest = elements.filter("kind <> 'node' AND size(tags) > 0").select("seq", "kind", "id", "tags").join(places, ["kind", "id"])
    return nodes.unionByName(rest.select("seq", "kind", "id", F.col("at_lat").alias("lat"), F.col("at_lon").alias("lon"), "tags"))


def place_types(elements: DataFrame) -> DataFrame:
    """(place, label): the first label of each place name by seq."""
    tags = F.col("tags")
    rows = elements.filter("kind IN ('node', 'way', 'relation')").select("seq", F.coalesce(tags["name"], tags["name:ru"]).alias("place"), text.place_label(tags).alias("label"))
    return rows.filter("place IS NOT NULL AND label IS NOT NULL").groupBy("place").agg(F.min_by("label", "seq").alias("label"))


def element_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("kind").agg(F.count("*").alias("n"))


def candidates(elements: DataFrame) -> DataFrame:
    """Elements that may become objects, with the fields of both sorts, before any repair.

    is_address tells that the element has an address key; a relation never is an address, and one of
    type associatedStreet is nothing.
    """
    tags = F.col("tags")
    has_address = (F.col("kind") != "relation") & F.coalesce(F.map_contains_key(tags, F.lit("addr:housenumber")) | F.map_contains_key(tags, F.lit("addr:street")) | F.map_contains_key(tags, F.lit("addr:city")), F.lit(False))
    named = ~((F.col("kind") == "relation") & F.coalesce(tags["type"] == "associatedStreet", F.lit(False)))
    category = F.when(tags["historic"].isNotNull(), "historic").when(tags["tourism"].isNotNull(), "tourism")
    return elements.select(
        "seq", "lat", "lon", has_address.alias("is_address"),
        tags["addr:country"].alias("country"),
        F.coalesce(tags["addr:city"], tags["addr:town"], tags["addr:place"]).alias("city"),
        F.coalesce(tags["addr:city"], tags["addr:town"], tags["addr:place"]).alias("raw_city"),
        tags["addr:street"].alias("street"), tags["addr:housenumber"].alias("housenumber"), tags["addr:postcode"].alias("postcode"),
        F.when(named, F.coalesce(tags["name:ru"], tags["name"])).alias("name"), F.when(named, category).alias("category"),
    ).filter("is_address OR (name IS NOT NULL AND category IS NOT NULL)")


def objects(elements: DataFrame, fix=None) -> DataFrame:
    """Objects (OBJECTS) of elements: an address if there is a street and a house number, else a point of interest if it has a name and category.

    ``fix`` takes the candidates and repairs city, street and name; by default broken characters are replaced.
    A missing street is made from the label of the place that the city names.
    """
    rows = candidates(located(elements))
    if fix is None:
        for c in ("city", "street", "name"):
            rows = rows.withColumn(c, text.normalize_chars(F.col(c)))
    else:
        rows = fix(rows)
    labelled = rows.join(place_types(elements), F.col("city") == F.col("place"), "left")
    street = F.coalesce("street", F.when(F.col("label").isNotNull(), F.concat_ws(" ", "label", "city")))
    ready = labelled.withColumn("street", street)
    address = F.col("is_address") & F.col("street").isNotNull() & F.col("housenumber").isNotNull()
    poi = ~address & F.col("name").isNotNull() & F.col("category").isNotNull()
    only = lambda c, keep: F.when(keep, F.col(c)).alias(c)
    out = ready.withColumn("a", address).withColumn("p", poi).filter("a OR p")
    city = F.when(F.col("a"), F.col("city")).otherwise(F.col("raw_city")).alias("city")
    return out.select("seq", F.when(F.col("a"), 0).otherwise(1).cast("tinyint").alias("type"), "lat", "lon", "country", city, *(only(c, F.col("a")) for c in ("street", "housenumber", "postcode")), *(only(c, F.col("p")) for c in ("name", "category")))


def inspect(elements: DataFrame, part: str, limit: int = 30) -> DataFrame:
    """The first elements by seq of which the name, city, street or place contains ``part``."""
    tags = F.col("tags")
    keys = ["name", "name:ru", "addr:city", "addr:street", "addr:place", "place"]
    hit = F.coalesce(F.greatest(*(F.coalesce(tags[k].contains(part), F.lit(False)) for k in keys)), F.lit(False))
    return elements.filter(hit).orderBy("seq").limit(limit)
