"""``python -m placeforge.cli build|query|info|list|generate``."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import datagen, index, search
from .plans import build as B
from .sources import files, osmpbf, regions


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="placeforge")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="build the tables from an extract")
    build.add_argument("input")
    build.add_argument("output")
    build.add_argument("--region", default="")
    build.add_argument("--dictionary")
    build.add_argument("--dictionary-url")
    build.add_argument("--base", default=regions.BASE)
    build.add_argument("--strict", action="store_true")
    build.add_argument("--format", action="append", choices=["parquet", "sqlite", "compact"])
    query = sub.add_parser("query", help="search a build")
    query.add_argument("db")
    query.add_argument("text")
    info = sub.add_parser("info", help="what a build holds")
    info.add_argument("db")
    listed = sub.add_parser("list", help="regions of a saved page")
    listed.add_argument("page")
    listed.add_argument("--parent", default="")
    pairs = sub.add_parser("generate", help="training pairs from a file of street names")
    pairs.add_argument("names")
    pairs.add_argument("output")
    pairs.add_argument("--split", type=float, default=0.9)
    pairs.add_argument("--seed", type=int, default=42)
    return top


def main(args: list[str] | None = None) -> list[str]:
    """Run a command; returns the printed lines."""
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    lines: list[str] = []
    if a.command == "build":
        path = regions.decompress(regions.resolve_input(a.input, base=a.base))
        spelled = files.find_dictionary(a.dictionary, a.dictionary_url)
        words = files.dictionary(spark, spelled) if spelled else None
        about = {"source": a.input, "source_sha256": files.digest(path)}
        objects = B.save(B.build(osmpbf.read(spark, path), a.region, words, a.strict))
        B.write(objects, a.output, a.region or None, **about)
        facts = objects.agg(F.count("*"), F.count_if(F.col("type") == 0), F.count_if(F.col("type") == 1)).first()
        if "sqlite" in (a.format or []):
            files.export_sqlite(objects, B.meta(objects, a.region, **about), a.output + ".db")
            files.finalize(a.output + ".db", a.region, a.input, tuple(facts), time.strftime("%Y-%m-%d"), B.VERSION)
        if "compact" in (a.format or []):
            index.write_compact(objects, a.output + ".bin", a.region, int(time.time()))
            files.finalize(a.output + ".bin", a.region, a.input, tuple(facts), time.strftime("%Y-%m-%d"), B.VERSION)
        lines.append(f"objects {facts[0]}, addresses {facts[1]}, named {facts[2]}")
    elif a.command == "query" and a.db.endswith(".db"):
        for kind, found in files.search_sqlite(a.db, a.text).items():
            lines.append(f"{kind}:")
            lines += [f"  {rank:.3f}  {line}  ({lat:.5f}, {lon:.5f})" for rank, lat, lon, line in found] or ["  (nothing found)"]
    elif a.command in ("query", "info") and a.db.endswith(".bin"):
        with open(a.db, "rb") as f:
            raw = f.read()
        lines += index.compact_report(raw) if a.command == "info" else [f"  {name}  ({lat:.5f}, {lon:.5f})" for name, lat, lon in index.find_compact(raw, a.text)] or ["  (nothing found)"]
    elif a.command == "query":
        objects = spark.read.parquet(f"{a.db}/objects")
        for kind in ("address", "named"):
            found = search.search(objects, spark.read.parquet(f"{a.db}/postings_{kind}"), spark.read.parquet(f"{a.db}/lengths_{kind}"), a.text, 10)
            rows = found.select("rank", "lat", "lon", search.address_line(found).alias("line")).orderBy("rank").collect()
            lines.append(f"{kind}:")
            lines += [f"  {r.rank:.3f}  {r.line}  ({r.lat:.5f}, {r.lon:.5f})" for r in rows] or ["  (nothing found)"]
    elif a.command == "info":
        sqlite = a.db.endswith(".db")
        objects = files.read_sqlite(spark, a.db) if sqlite else spark.read.parquet(f"{a.db}/objects")
        facts = files.read_sqlite(spark, a.db, "meta") if sqlite else spark.read.parquet(f"{a.db}/meta")
        lines += [f"{r.key}: {r.value}" for r in facts.orderBy("key").collect()]
        lines += [f"size: {files.megabytes(os.path.getsize(a.db))}"] if sqlite else []
        r = objects.agg(F.count("*").alias("n"), F.count_if(F.col("type") == 0).alias("a")).first()
        lines.append(f"objects {r.n}, addresses {r.a}, named {r.n - r.a}")
    elif a.command == "generate":
        names = spark.read.text(a.names).select(F.trim("value").alias("name")).filter("name <> ''").distinct()
        lines += [f"{key}: {n}" for key, n in datagen.write_dataset(names, a.output, a.seed, a.split).items()]
    else:
        with open(a.page) as f:
            page = spark.createDataFrame([(f.read(),)], "html string")
        lines += [f"{r.name:40} {r.subpath:50} {regions.size_text(r.size_mb)}" for r in regions.region_table(page, a.parent).collect()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
