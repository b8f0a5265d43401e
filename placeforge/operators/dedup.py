"""Removal of repeated addresses and of points of interest that repeat nearby."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import EARTH_M, cell3, haversine, haversine_m

#: Points of the same name nearer than this are one.
RADIUS_M = 100.0
#: Objects of one name up to which one task goes through them in order.
SMALL = 20_000
#: Cells of this width have no two points as far apart as RADIUS_M.
CELL_M = 57.0
#: From a cell to itself and its 26 neighbours.
STEPS = list(product((-1, 0, 1), repeat=3))
KEY = ["country", "city", "street", "housenumber"]


def addresses(objects: DataFrame) -> DataFrame:
    """The first address by seq of each (country, city, street, house number); null differs from empty."""
    keys = [text.dedup_key(F.col(c)).alias(f"key_{k}") for k, c in enumerate(KEY)]
    first = objects.groupBy(*keys).agg(F.min_by(F.struct("*"), "seq").alias("row"))
    return first.select("row.*")


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """The seqs that stay, in order; kept points lie in cubic cells of RADIUS_M, so each meets those of 27 cells alone."""
    kept: dict[tuple[int, int, int], list[tuple[float, float]]] = {}
    keep = []
    rows = rows.sort_values("seq")
    p, q, r = np.radians(rows.lat.to_numpy(float)), np.radians(rows.lon.to_numpy(float)), EARTH_M / RADIUS_M
    # a point without coordinates is near nothing: it has a cell of its own kind
    at = np.nan_to_num(np.floor(np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], 1) * r), nan=1e12).astype(np.int64)
    for seq, lat, lon, (x, y, z) in zip(rows.seq, rows.lat, rows.lon, at.tolist(), strict=True):
        near = (k for i, j, m in STEPS for k in kept.get((x + i, y + j, z + m), ()))
        if not any(haversine_m(lat, lon, v, w) < RADIUS_M for v, w in near):
            kept.setdefault((x, y, z), []).append((lat, lon))
            keep.append(seq)
    return pd.DataFrame({"seq": keep})


def _rounds(rows: DataFrame, save) -> DataFrame:
    """The same result for names of any size, in rounds of joins on cells.

    In a round every cell's first undecided object is a candidate.  It stays if no earlier undecided
    object of the neighbouring cells is within the radius; then all later ones within the radius go.
    """
    open_ = save(rows.withColumn("cell", cell3(F.col("lat"), F.col("lon"), CELL_M)))
    kept = None
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in product(range(-2, 3), repeat=3)))
    near = lambda c: F.struct((F.col(f"{c}.x") + F.col("s.x")).alias("x"), (F.col(f"{c}.y") + F.col("s.y")).alias("y"), (F.col(f"{c}.z") + F.col("s.z")).alias("z"))
    while open_.limit(1).count():
        first = open_.groupBy("name", "cell").agg(F.min(F.struct("seq", "lat", "lon")).alias("f")).select("name", "cell", "f.*")
        around = first.withColumn("s", F.explode(steps)).select("name", F.col("seq").alias("fseq"), F.col("lat").alias("flat"), F.col("lon").alias("flon"), near("cell").alias("cell"))
        touch = open_.join(around, ["name", "cell"]).filter(haversine(F.col("lat"), F.col("lon"), F.col("flat"), F.col("flon")) < RADIUS_M)
        blocked = touch.filter("seq < fseq").select("fseq").distinct()
        now = save(first.select("name", "seq", "lat", "lon", "cell").join(blocked, F.col("seq") == F.col("fseq"), "left_anti"))
        kept = now.select("seq") if kept is None else kept.unionByName(now.select("seq"))
        gone = touch.join(now.select(F.col("seq").alias("kseq")), F.col("fseq") == F.col("kseq"), "left_semi").select(F.col("seq").alias("gseq")).distinct()
        open_ = save(open_.join(gone, F.col("seq") == F.col("gseq"), "left_anti"))
    return kept if kept is not None else rows.select("seq")


def poi_keepers(objects: DataFrame, small: int = SMALL) -> DataFrame:
    """(seq) of the points that stay: in order of seq, each that is RADIUS_M or more from all kept ones of its name."""
    rows = objects.select("seq", "name", "lat", "lon")
    sizes = rows.groupBy("name").agg(F.count("*").alias("c"))
    sized = rows.join(sizes, "name")
    single = sized.filter("c = 1").select("seq")
    middle = sized.filter(F.col("c").between(2, small)).select("seq", "name", "lat", "lon").groupBy("name").applyInPandas(_greedy, "seq long")
    out = single.unionByName(middle)
    large = sizes.filter(F.col("c") > small)
    if large.limit(1).count():
        from ..plans.build import save

        out = out.unionByName(_rounds(sized.filter(F.col("c") > small).drop("c"), save))
    return out


def points(objects: DataFrame, small: int = SMALL) -> DataFrame:
    return objects.join(poi_keepers(objects, small).withColumnRenamed("seq", "kept"), F.col("seq") == F.col("kept"), "left_semi")


def objects_once(objects: DataFrame) -> DataFrame:
    """Addresses and points without repeats; the two sorts don't meet."""
    return addresses(objects.filter("type = 0")).unionByName(points(objects.filter("type = 1")))


__all__ = ["addresses", "objects_once", "poi_keepers", "points"]
