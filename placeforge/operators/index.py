"""Dictionary encoding, sorted records and indexes, and the compact binary file.

The tables are DataFrames; the file is written by the driver from sorted rows that it streams.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# The compact file's head.
MAGIC, VERSION = b"OSMG", 1
HEAD = "<4sHIIIQ46sIIII"
REGION_BYTES = 45


def numbered(rows: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Rows with their number in sorted order: a range sort, then the sizes of its partitions; no single task sees all rows."""
    ordered = rows.orderBy(*order).withColumn("part_", F.spark_partition_id()).withColumn("in_", F.monotonically_increasing_id())
    from ..plans.build import save

    kept = save(ordered)
    sizes = kept.groupBy("part_").agg(F.count("*").alias("n_"), F.min("in_").alias("first_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).select("part_", "first_", "before_")
    return kept.join(F.broadcast(starts), "part_").withColumn(name, F.col("in_") - F.col("first_") + F.col("before_") + start).drop("part_", "in_", "first_", "before_")


def string_pool(objects: DataFrame) -> DataFrame:
    """(idx, value) in order of first use; 0 is the empty string, as are nulls."""
    first = F.array(*(F.col(c) for c in ("city", "street", "housenumber", "country", "postcode")))
    second = F.array(*(F.col(c) for c in ("country", "city", "name")))
    used = objects.select("seq", F.posexplode(F.when(F.col("type") == 0, first).otherwise(second)).alias("at", "value"))
    distinct = used.filter("value <> ''").groupBy("value").agg(F.min(F.struct("seq", "at")).alias("first"))
    pool = numbered(distinct, ["first.seq", "first.at"], "idx", 1).select("idx", "value")
    return objects.sparkSession.createDataFrame([(0, "")], "idx long, value string").unionByName(pool)


def records(objects: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Records by (lat, lon, seq): record_idx, type, coordinates as 32-bit floats, category code, strings as pool numbers (with ``pool``)."""
    rows = numbered(objects, ["lat", "lon", "seq"], "record_idx")
    rows = rows.withColumns({"lat32": F.col("lat").cast("float"), "lon32": F.col("lon").cast("float"), "category_code": text.category_code(F.col("category"))})
    for c in ("country", "city", "street", "housenumber", "name") if pool is not None else ():
        known = pool.select(F.col("idx").alias(f"{c}_idx"), F.col("value").alias("v_"))
        rows = rows.join(known, F.col(c) == F.col("v_"), "left").drop("v_").withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", F.lit(0)))
    return rows


def named_index(recorded: DataFrame) -> DataFrame:
    return recorded.filter("type = 1").withColumn("key", F.lower("name")).orderBy("key", "record_idx")


def address_index(recorded: DataFrame) -> DataFrame:
    keys = {f"{c}_key": F.lower(F.coalesce(c, F.lit(""))) for c in ("city", "street", "housenumber")}
    return recorded.filter("type = 0").withColumns(keys).orderBy(*keys, "record_idx")


def find_name(indexed: DataFrame, query: str, prefix: bool = True) -> DataFrame:
    """By lowered name, whole or from its start; on a sorted table the scan skips row groups."""
    q = query.lower()
    return indexed.filter(F.col("key").startswith(q) if prefix else F.col("key") == q)


def find_address(indexed: DataFrame, city: str, street: str, housenumber: str) -> DataFrame:
    return indexed.filter((F.col("city_key") == city.lower()) & (F.col("street_key") == street.lower()) & (F.col("housenumber_key") == housenumber.lower()))


def find_pool(pool: DataFrame, part: str) -> DataFrame:
    return pool.filter(F.lower("value").contains(part.lower()))


def write_sorted(rows: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """Parquet, range-partitioned and sorted, so that filters on the leading columns skip files and row groups."""
    parts = rows.repartitionByRange(files, *columns) if files else rows.repartitionByRange(*columns)
    parts.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def write_compact(objects: DataFrame, path: str, region: str, timestamp: int) -> None:
    """The compact binary file on the driver's disk; more than 65 535 strings don't fit its 16-bit numbers and raise."""
    pool = string_pool(objects)
    n_pool = pool.count()
    if n_pool > 1 << 16:
        raise OverflowError(f"{n_pool} strings exceed the format's 16-bit numbers")
    recorded = records(objects, pool)
    counts = {r.type: r["count"] for r in recorded.groupBy("type").count().collect()}
    n_addr, n_named = counts.get(0, 0), counts.get(1, 0)
    pool_bytes = pool.agg(F.sum(F.octet_length("value") + 2).alias("b")).first()["b"]
    at_pool = struct.calcsize(HEAD)
    at_named = at_pool + 4 + pool_bytes
    at_addr = at_named + 4 + 7 * n_named
    at_records = at_addr + 4 + 10 * n_addr
    name = region.encode()[:REGION_BYTES]
    count = struct.Struct("<I").pack

    def each(rows: DataFrame) -> Iterable:
        return rows.toLocalIterator()

    with open(path, "wb") as f:
        f.write(struct.pack(HEAD, MAGIC, VERSION, n_addr + n_named, n_addr, n_named, timestamp, name, at_pool, at_named, at_addr, at_records))
        f.write(count(n_pool))
        for r in each(pool.orderBy("idx")):
            raw = r.value.encode()
            f.write(struct.pack("<H", len(raw)) + raw)
        f.write(count(n_named))
        for r in each(named_index(recorded).select("name_idx", "category_code", "record_idx")):
            f.write(struct.pack("<HBI", *r))
        f.write(count(n_addr))
        for r in each(address_index(recorded).select("city_idx", "street_idx", "housenumber_idx", "record_idx")):
            f.write(struct.pack("<HHHI", *r))
        f.write(count(n_addr + n_named))
        for r in each(recorded.orderBy("record_idx").select("type", "lat32", "lon32", "country_idx", "city_idx", "street_idx", "housenumber_idx", "name_idx", "category_code")):
            if r.type == 0:
                f.write(struct.pack("<BffHHH", 0, r.lat32, r.lon32, r.city_idx, r.street_idx, r.housenumber_idx))
            else:
                f.write(struct.pack("<BffHHHB", 1, r.lat32, r.lon32, r.country_idx, r.city_idx, r.name_idx, r.category_code))


def read_compact(raw: bytes) -> dict:
    """Head, pool, indexes and records of a compact file."""
    magic, version, n, n_addr, n_named, timestamp, region, at_pool, at_named, at_addr, at_records = struct.unpack_from(HEAD, raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a compact file")
    at, pool = at_pool + 4, []
    for _ in range(struct.unpack_from("<I", raw, at_pool)[0]):
        (size,) = struct.unpack_from("<H", raw, at)
        pool.append(raw[at + 2 : at + 2 + size].decode())
        at += 2 + size
    named = [struct.unpack_from("<HBI", raw, at_named + 4 + 7 * i) for i in range(n_named)]
    addresses = [struct.unpack_from("<HHHI", raw, at_addr + 4 + 10 * i) for i in range(n_addr)]
    at, rows = at_records + 4, []
    for _ in range(n):
        form = struct.Struct("<BffHHH" if raw[at] == 0 else "<BffHHHB")
        rows.append(form.unpack_from(raw, at))
        at += form.size
    head = {"records": n, "addresses": n_addr, "named": n_named, "timestamp": timestamp, "region": region.rstrip(b"\0").decode(), "offsets": (at_pool, at_named, at_addr, at_records)}
    return {"head": head, "pool": pool, "named": named, "addresses": addresses, "records": rows}


def compact_report(raw: bytes) -> list[str]:
    """What a compact file holds, section by section."""
    got = read_compact(raw)
    head, pool = got["head"], got["pool"]
    ends = [*head["offsets"][1:], len(raw)]
    sections = [f"{name}: {end - at} bytes at {at}" for name, at, end in zip(("pool", "named index", "address index", "records"), head["offsets"], ends, strict=True)]
    names = [pool[r[5]] for r in got["records"] if r[0] == 1]
    facts = [f"region {head['region']!r}, built {head['timestamp']}", f"records {head['records']}: addresses {head['addresses']}, named {head['named']}", f"strings {len(pool)}, longest {max(map(len, pool))}"]
    ordered = got["named"] == sorted(got["named"], key=lambda e: (pool[e[0]].lower(), e[2]))
    return [*facts, *sections, f"named index {'in order' if ordered else 'NOT in order'}", *(f"  {n}" for n in names[:5])]


def find_compact(raw: bytes, query: str, limit: int = 10) -> list[tuple]:
    """(name, lat, lon) of the records of a compact file whose lowered name starts with the query, by binary search in the named index."""
    from bisect import bisect_left

    got = read_compact(raw)
    pool, named, q = got["pool"], got["named"], query.lower()
    at = bisect_left(named, q, key=lambda e: pool[e[0]].lower())
    found = []
    while at < len(named) and len(found) < limit and pool[named[at][0]].lower().startswith(q):
        record = got["records"][named[at][2]]
        found.append((pool[named[at][0]], record[1], record[2]))
        at += 1
    return found


def compact_objects(spark, path: str) -> DataFrame:
    """The objects of compact files as rows, one task a file."""

    def decode(batches):
        import pandas as pd

        for files in batches:
            for raw in files.content:
                got = read_compact(raw)
                p, out = got["pool"], []
                for i, r in enumerate(got["records"]):
                    if r[0] == 0:
                        out.append((i, 0, r[1], r[2], None, p[r[3]], p[r[4]], p[r[5]], None, None))
                    else:
                        out.append((i, 1, r[1], r[2], p[r[3]], p[r[4]], None, None, p[r[5]], r[6]))
                yield pd.DataFrame(out, columns=["record_idx", "type", "lat", "lon", "country", "city", "street", "housenumber", "name", "category_code"])

    schema = "record_idx long, type int, lat float, lon float, country string, city string, street string, housenumber string, name string, category_code int"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, schema)
