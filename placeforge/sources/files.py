"""Dictionaries, exports and final files."""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq) of lines ``word frequency``."""
    return spark.read.schema("term string, freq long").option("sep", " ").option("quote", "").csv(path).filter("term IS NOT NULL AND freq IS NOT NULL")


#: Where a dictionary is looked for, in order, beside what ``PLACEFORGE_DICTIONARY`` names.
PLACES = ["dictionary.txt", "data/dictionary.txt", "~/.local/share/placeforge/dictionary.txt"]


def find_dictionary(given: str | None = None, fetch_from: str | None = None, fetch=None) -> str | None:
    """The dictionary's path: the one given, else the first that exists; else it is fetched, if there is an address; else None."""
    if given:
        if not os.path.exists(given):
            raise FileNotFoundError(given)
        return given
    known = [os.environ.get("PLACEFORGE_DICTIONARY", ""), *map(os.path.expanduser, PLACES)]
    found = next((p for p in known if p and os.path.exists(p)), None)
    if found is None and fetch_from:
        from .regions import download

        found = (fetch or download)(fetch_from, os.path.basename(PLACES[0]))
    return found


def megabytes(size: int) -> str:
    """A file's size as text."""
    return f"{size / 1_048_576:.1f} MB"


# Names of tables and columns of the SQLite file.
COLUMNS = ["id", "type", "lat", "lon", "country", "city", "street", "housenumber", "postcode", "name", "category"]


def export_sqlite(objects: DataFrame, meta: DataFrame, path: str, batch: int = 10_000) -> None:
    """A SQLite file with objects, full-text tables and meta, from rows streamed in order of id."""
    if os.path.exists(path):
        os.remove(path)
    db = sqlite3.connect(path)
    db.executescript(
        "CREATE TABLE objects (id INTEGER PRIMARY KEY, type INTEGER NOT NULL, lat REAL NOT NULL, lon REAL NOT NULL, country TEXT, city TEXT, street TEXT, housenumber TEXT, postcode TEXT, name TEXT, category TEXT);"
        "CREATE INDEX objects_place ON objects(lat, lon);"
        "CREATE VIRTUAL TABLE fts_named USING fts5(country, city, name, category, content='', tokenize='unicode61', prefix='2 3 4');"
        "CREATE VIRTUAL TABLE fts_address USING fts5(country, city, street, housenumber, postcode, content='', tokenize='unicode61', prefix='2 3 4');"
        "CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT NOT NULL);"
    )
    from ..functions.stem import stem_words

    words = lambda v: stem_words(v or "")
    rows: list = []

    def flush() -> None:
        with db:
            db.executemany(f"INSERT INTO objects VALUES ({','.join('?' * len(COLUMNS))})", [tuple(r) for r in rows])
            db.executemany("INSERT INTO fts_address(rowid, country, city, street, housenumber, postcode) VALUES (?,?,?,?,?,?)", [(r.id, words(r.country), words(r.city), words(r.street), r.housenumber or "", r.postcode or "") for r in rows if r.type == 0])
            db.executemany("INSERT INTO fts_named(rowid, country, city, name, category) VALUES (?,?,?,?,?)", [(r.id, words(r.country), words(r.city), words(r.name), r.category or "") for r in rows if r.type == 1])
        rows.clear()

    for r in objects.select(*COLUMNS).orderBy("id").toLocalIterator():
        rows.append(r)
        if len(rows) == batch:
            flush()
    flush()
    with db:
        db.executemany("INSERT OR REPLACE INTO meta VALUES (?, ?)", [(r.key, r.value) for r in meta.collect()])
        db.execute("INSERT INTO fts_named(fts_named) VALUES ('optimize')")
        db.execute("INSERT INTO fts_address(fts_address) VALUES ('optimize')")
    db.execute("ANALYZE")
    db.close()


def read_sqlite(spark: SparkSession, path: str, table: str = "objects", columns: str | None = None, parts: int = 8) -> DataFrame:
    """A table of a SQLite file; ``objects`` is read in ``parts`` ranges of its id, each by a task of its own that sees the file."""
    kinds = columns or ("id long, type int, lat double, lon double, country string, city string, street string, housenumber string, postcode string, name string, category string" if table == "objects" else "key string, value string")
    names = ", ".join(c.split()[0] for c in kinds.split(", "))
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    low, high = db.execute("SELECT min(rowid), max(rowid) FROM " + table).fetchone()
    db.close()
    step = -(-((high or 0) - (low or 0) + 1) // parts)
    ranges = spark.createDataFrame([((low or 0) + k * step, (low or 0) + (k + 1) * step) for k in range(parts)], "a long, b long").repartition(parts, "a")

    def read(batches):
        import pandas as pd

        own = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        for frame in batches:
            for a, b in zip(frame.a.tolist(), frame.b.tolist(), strict=True):
                found = own.execute(f"SELECT {names} FROM {table} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (a, b))
                while rows := found.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names.split(", "), dtype=object)
        own.close()

    return ranges.mapInPandas(read, kinds)


def search_sqlite(path: str, query: str, limit: int = 10) -> dict[str, list[tuple]]:
    """By the file's own full-text tables: {kind: [(rank, lat, lon, line)]}; every query word is a prefix."""
    from ..operators.search import prefixes

    asked = " ".join(f'"{p}"*' for p in prefixes(query))
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    lines = {"address": "concat_ws(', ', o.country, o.city, o.street, o.housenumber)", "named": "coalesce(o.name, '?') || ' (' || coalesce(o.category, 'без категории') || ')'"}
    if sqlite3.sqlite_version_info < (3, 44):
        lines["address"] = "ltrim(coalesce(', ' || o.country, '') || coalesce(', ' || o.city, '') || coalesce(', ' || o.street, '') || coalesce(', ' || o.housenumber, ''), ', ')"
    try:
        return {kind: db.execute(f"SELECT f.rank, o.lat, o.lon, {line} FROM fts_{kind} f JOIN objects o ON o.id = f.rowid WHERE fts_{kind} MATCH ? ORDER BY f.rank, o.id LIMIT ?", (asked, limit)).fetchall() if asked else [] for kind, line in lines.items()}
    finally:
        db.close()


def digest(path: str) -> str:
    """SHA-256 of a local file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def finalize(path: str, region: str, source: str, counts: tuple[int, int, int], build_date: str, version: str, level: int = 3) -> dict:
    """Compress a file beside itself and write its metadata; each file keeps its own extension, and the digest is of the plain file."""
    import zstandard

    with open(path, "rb") as a, open(path + ".zst", "wb") as b:
        zstandard.ZstdCompressor(level=level).copy_stream(a, b)
    out = {"version": version, "region": region, "build_date": build_date, "source_pbf": source, "object_count": counts[0], "address_count": counts[1], "named_count": counts[2], "db_size_bytes": os.path.getsize(path), "compressed_size_bytes": os.path.getsize(path + ".zst"), "sha256": digest(path)}
    with open(path + ".metadata.json", "w") as f:
        json.dump(out, f, ensure_ascii=False, indent=2)
    return out


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
