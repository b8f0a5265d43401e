"""From elements to the finished tables, in build order."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import neural, spell, text
from ..operators import dedup, extract, index, infer, search, stats

VERSION = "0.2.0"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary one, on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="placeforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Write into the shared folder, until the application ends, and read back: cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repair(rows: DataFrame, dictionary: DataFrame | None, strict: bool) -> DataFrame:
    """City, street and name of candidates: spelling, grammar and letter case with a dictionary, else broken characters only."""
    for c in ("city", "street", "name"):
        if dictionary is not None:
            rows = spell.correct(rows, c, dictionary)
            rows = rows.withColumn(c, text.repair(F.col(c)) if strict else text.normalize_chars(F.col(c)))
        else:
            rows = rows.withColumn(c, text.normalize_chars(F.col(c)))
    return rows


def normalize(objects: DataFrame, strict: bool, model: Callable | None = None) -> DataFrame:
    """City and street of addresses and names of points, by rules and then by ``model``; the city of a point stays."""
    fix = text.normalize_rule_based if strict else (lambda c: text.normalize_name(c))
    own = lambda c, kind, f: F.when(F.col("type") == kind, f(F.col(c))).otherwise(F.col(c))
    city_fix = text.normalize_rule_based if strict else (lambda c: text.normalize_oblique(c))
    ruled = objects.withColumns({"city": own("city", 0, city_fix), "street": own("street", 0, fix), "name": own("name", 1, fix)})
    if model is None:
        return ruled
    ruled = save(ruled)
    return neural.refine(ruled.filter("type = 0"), ["city", "street"], model).unionByName(neural.refine(ruled.filter("type = 1"), ["name"], model))


def build(elements: DataFrame, region: str | None = None, dictionary: DataFrame | None = None, strict: bool = False, model: Callable | None = None) -> DataFrame:
    """The objects table: id and the columns of extract.OBJECTS.

    ``strict`` keeps the original chain with its known slips; else abbreviations are written out
    before grammar, place names aren't taken for abbreviations, and cities aren't averaged with (0, 0).
    ``model`` loads a trained normaliser (see :func:`neural.refine`).
    """
    # a source is decoded once, however many branches read its elements
    elements = save(elements)
    found = save(extract.objects(elements, lambda rows: repair(rows, dictionary, strict)))
    filled = save(infer.fill_cities(found, skip_origin=not strict))
    merged = infer.merge_typos(filled)
    named = save(normalize(infer.fill_countries(merged, region), strict, model))
    once = dedup.objects_once(named)
    return index.numbered(once, ["seq"], "id", 1).select("id", *extract.OBJECTS)


def meta(objects: DataFrame, region: str | None, **more: str) -> DataFrame:
    """(key, value), sorted by key."""
    counts = stats.object_counts(objects).first()
    rows = {"source": more.pop("source", ""), "build_date": datetime.datetime.now(datetime.UTC).date().isoformat(), "version": VERSION, "object_count": counts.objects, "addr_count": counts.addresses, "named_count": counts.named} | ({"region": region} if region else {}) | more
    return objects.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(rows.items())], "key string, value string")


FTS = {0: ["country", "city", "street", "housenumber", "postcode"], 1: ["country", "city", "name", "category"]}


def text_index(objects: DataFrame, kind: int) -> DataFrame:
    """Postings of one sort of objects; places and names are stemmed, numbers and categories aren't."""
    return search.with_prefixes(search.postings(objects.filter(F.col("type") == kind), FTS[kind], stemmed=("country", "city", "street", "name")))


def write(objects: DataFrame, path: str, region: str | None, **more: str) -> None:
    """objects (sorted by place), postings (sorted by term), lengths and meta as Parquet."""
    index.write_sorted(objects, f"{path}/objects", ["lat", "lon"])
    for kind, name in ((0, "address"), (1, "named")):
        posted = save(text_index(objects, kind))
        index.write_sorted(posted, f"{path}/postings_{name}", ["term", "doc_id"])
        search.lengths(posted).write.mode("overwrite").parquet(f"{path}/lengths_{name}")
    meta(objects, region, **more).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
