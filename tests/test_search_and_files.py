import gzip
import json
import sqlite3
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from placeforge import cli
from placeforge.functions import geo
from placeforge.operators import datagen, index, search, stats
from placeforge.plans import build
from placeforge.sources import files, osmpbf, regions

from .test_objects import obj, objects

ROWS = [
    ("Россия", "Москва", "Красная площадь", "tourism"), ("Россия", "Москва", "Большой театр", "historic"), ("Россия", "Санкт-Петербург", "Дворцовая площадь", "historic"),
    ("France", "Café été", "Pont Neuf 15", "historic"), (None, "Москва", "Москва-река Москва", None), ("Россия", None, "Площадь 150", "tourism"), ("", "", "a_b №5", "x"),
]


def indexed(spark):
    rows = [(k + 1, 1, 50.0 + k, 30.0 + k, *r) for k, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "id long, type int, lat double, lon double, country string, city string, name string, category string")


@pytest.mark.parametrize("query", ["москва", "площ", "площад крас", "15", "moscow", "cafe", "москв москв", "петербург санкт", "a b"])
def test_bm25_equals_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(country, city, name, category, content='', tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, country, city, name, category) VALUES (?,?,?,?,?)", [(k + 1, *(x or "" for x in r)) for k, r in enumerate(ROWS)])
    want = db.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid", (" ".join(f"{w}*" for w in query.split()),)).fetchall()
    posted = search.postings(indexed(spark), ["country", "city", "name", "category"])
    got = search.top(search.bm25(posted, search.lengths(posted), query.split())).collect()
    assert [(r.doc_id, pytest.approx(r.rank, abs=1e-12)) for r in got] == want


def test_search_with_stems(spark):
    df = indexed(spark)
    posted = build.text_index(df, 1)
    sizes = search.lengths(posted)
    names = lambda q, **k: [r.name for r in search.search(df, posted, sizes, q, **k).collect()]
    assert names("Красной площади") == ["Красная площадь"]
    assert names("москве", category="historic") == ["Большой театр"]
    assert names("москва", box=(50, 50.5, 29, 31)) == ["Красная площадь"]
    assert names("санкт-петербург") == ["Дворцовая площадь"] and names("санкт-петербург", strict=True) == [] and names("") == []
    assert search.fuzzy(df, "name", "Краснаяя площадь").first().name == "Красная площадь"
    assert [r.id for r in search.nearest_points(df, 50.4, 30.4, 2).collect()] == [1, 2]
    lines = objects(spark, obj(1, 1, name="Форт"), obj(2, city="А", street="Б"))
    assert [r.l for r in lines.orderBy("seq").select(search.address_line(lines).alias("l")).collect()] == ["Форт (без категории)", "А, Б"]


def test_compact_round_trip(spark, tmp_path):
    df = objects(spark, obj(1, 1, 55.0, 37.0, name="В", category="historic"), obj(2, 1, 56.0, 37.0, name="Б"), obj(3, 1, 57.0, 37.0, name="А", city="Большое Исаково"), obj(4, lat=54.0, city="Москва", street="Я", housenumber="10"), obj(5, lat=53.0, city="Москва", street="А", housenumber="1", country="RU"))
    path = str(tmp_path / "x.bin")
    index.write_compact(df, path, "регион", 7)
    raw = open(path, "rb").read()
    got = index.read_compact(raw)
    assert struct.calcsize(index.HEAD) == 88 and got["head"]["region"] == "регион" and (got["head"]["addresses"], got["head"]["named"]) == (2, 3)
    assert got["pool"][:4] == ["", "В", "Б", "Большое Исаково"] and len(set(got["pool"])) == len(got["pool"])
    assert [got["pool"][n] for n, _, _ in got["named"]] == ["А", "Б", "В"]
    assert [got["pool"][s] for _, s, _, _ in got["addresses"]] == ["А", "Я"]
    assert [round(r[1]) for r in got["records"]] == [53, 54, 55, 56, 57]
    assert got["records"][2][6] == 4
    back = index.compact_objects(spark, path)
    assert back.count() == 5 and back.filter("name = 'А'").first().city == "Большое Исаково"
    small = index.find_address(index.address_index(index.records(df)), "МОСКВА", "я", "10").collect()
    assert [r.seq for r in small] == [4]


def test_compact_refuses_too_many_strings(spark, tmp_path):
    df = spark.range(66_000).select(F.col("id").alias("seq"), F.lit(1).cast("tinyint").alias("type"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), *(F.lit(None).cast("string").alias(c) for c in ("country", "city", "street", "housenumber", "postcode")), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(None).cast("string").alias("category"))
    with pytest.raises(OverflowError):
        index.write_compact(df, str(tmp_path / "y.bin"), "r", 1)


def test_sqlite_and_metadata(spark, tmp_path):
    df = objects(spark, obj(1, country="Россия", city="Москва", street="Тверская", housenumber="1", postcode="125009"), obj(2, 1, country="Россия", city="Москва", name="Красная площадь", category="tourism")).withColumn("id", F.col("seq"))
    path = str(tmp_path / "a.db")
    files.export_sqlite(df, build.meta(df, "moscow"), path)
    db = sqlite3.connect(path)
    assert db.execute("SELECT rowid FROM fts_address WHERE fts_address MATCH 'москв* тверск*'").fetchall() == [(1,)]
    assert db.execute("SELECT rowid FROM fts_named WHERE fts_named MATCH 'красн* площад*'").fetchall() == [(2,)]
    assert dict(db.execute("SELECT key, value FROM meta ORDER BY key"))["addr_count"] == "1"
    facts = files.finalize(path, "moscow", "x.pbf", (2, 1, 1), "2024-01-01", "0.2.0")
    assert json.load(open(path + ".metadata.json")) == facts and facts["compressed_size_bytes"] > 0
    assert files.checksums(spark, path).first().sha256 == facts["sha256"]


def test_regions(spark):
    html = '<a href="russia/central-fed-district-latest.osm.pbf">[.osm.pbf]</a> (828&nbsp;MB)\n<a href="russia/a/b-latest.osm.pbf">[.osm.pbf]</a> (1.2 GB)<a href="x.pbf">y</a>'
    page = spark.createDataFrame([(html,)], "html string")
    assert [tuple(r) for r in regions.region_table(page, "russia").collect()] == [("central fed district", "russia/central-fed-district", 828.0)]
    assert regions.region_table(page).count() == 2 and regions.region_table(page, "rus").count() == 0
    assert [regions.size_text(x) for x in (828, 1228.8)] == ["828 MB", "1.2 GB"]


def test_archives(tmp_path):
    plain, packed = tmp_path / "a.txt", tmp_path / "b.txt.gz"
    plain.write_text("x")
    packed.write_bytes(gzip.compress(b"data"))
    assert regions.decompress(str(plain)) == str(plain)
    assert open(regions.decompress(str(packed))).read() == "data"
    (tmp_path / "c.gz").write_text("no archive")
    with pytest.raises(ValueError):
        regions.decompress(str(tmp_path / "c.gz"))
    with pytest.raises(FileNotFoundError):
        regions.resolve_input(str(tmp_path / "none"))


def message(*parts):
    """A protobuf message of (number, int or bytes)."""
    out = b""
    for n, v in parts:
        out += varint(n << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v)
    return out


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


zigzag = lambda n: n << 1 if n >= 0 else (-n << 1) - 1
packed = lambda *v: b"".join(map(varint, v))


def blob(kind, data, pack=True):
    body = message((2, len(data)), (3, zlib.compress(data))) if pack else message((1, data))
    head = message((1, kind.encode()), (3, len(body)))
    return struct.pack(">I", len(head)) + head + body


def make_pbf(path):
    strings = ["", "addr:street", "Тверская", "addr:housenumber", "1", "name", "Форт", "historic", "yes", "outer"]
    table = message(*((1, s.encode()) for s in strings))
    e7 = lambda x: zigzag(round(x * 1e7))
    dense = message((1, packed(zigzag(5), zigzag(1))), (8, packed(e7(55.5), e7(0.5))), (9, packed(e7(37.5), e7(-1.0))), (10, packed(1, 2, 3, 4, 0, 0)))
    plain = message((1, zigzag(9)), (2, packed(5)), (3, packed(6)), (8, e7(-10.0)), (9, e7(20.0)))
    way = message((1, 20), (2, packed(5, 7)), (3, packed(6, 8)), (8, packed(zigzag(5), zigzag(1), zigzag(-1))))
    relation = message((1, 30), (8, packed(9)), (9, packed(zigzag(20))), (10, packed(1)))
    first = message((1, table), (2, message((2, dense), (1, plain))))
    second = message((1, table), (2, message((3, way))), (2, message((4, relation))))
    path.write_bytes(blob("OSMHeader", message((4, b"x"))) + blob("OSMData", first) + blob("OSMData", second, pack=False))


def test_pbf_source_and_cli(spark, tmp_path):
    make_pbf(tmp_path / "t.osm.pbf")
    rows = osmpbf.read(spark, str(tmp_path / "t.osm.pbf")).orderBy("seq").collect()
    assert [(r.kind, r.id) for r in rows] == [("node", 5), ("node", 6), ("node", 9), ("way", 20), ("relation", 30)]
    assert rows[0].tags == {"addr:street": "Тверская", "addr:housenumber": "1"} and rows[1].tags == {} and rows[2].tags == {"name": "Форт"}
    assert (round(rows[1].lat, 7), round(rows[1].lon, 7)) == (56.0, 36.5) and rows[2].lat == pytest.approx(-10.0)
    assert rows[3].refs == [5, 6, 5] and rows[4].members[0].ref == 20 and rows[4].members[0].role == "outer"
    assert rows[0].seq == 1 << 32 and rows[3].seq == 2 << 32
    out = str(tmp_path / "db")
    assert cli.main(["build", str(tmp_path / "t.osm.pbf"), out, "--region", "RU-X", "--format", "sqlite", "--format", "compact"]) == ["objects 2, addresses 1, named 1"]
    found = cli.main(["query", out, "тверской 1"])
    assert any("RU, Тверская, 1" in line for line in found) and found[-1] == "  (nothing found)"
    assert "objects 2, addresses 1, named 1" in cli.main(["info", out])
    page = tmp_path / "p.html"
    page.write_text('<a href="a/b-latest.osm.pbf">[.osm.pbf]</a> (3 MB)')
    assert "a/b" in cli.main(["list", str(page), "--parent", "a"])[0]


def test_pairs(spark):
    names = spark.createDataFrame([("Ленина",), ("Мира",)], "name string")
    assert datagen.abbreviation_pairs(names).count() == 2 * 24 * 3
    assert datagen.oblique_pairs(names).count() == 2 * 44 * 2
    assert datagen.suffixed_pairs(names).count() == 2 * 24 * 8 + 2 * 8 * 8
    pairs = datagen.unchanged_pairs(names, ["улица", "мост"], ["Москва"])
    assert pairs.count() == 5 and pairs.filter("input <> output").count() == 0
    adjectives = spark.createDataFrame([("Синей", "Синий", "m"), ("Синей", "Синее", "n")], "oblique string, nominative string, gender string")
    nouns = spark.createDataFrame([("мост", "m"), ("поле", "n"), ("улица", "f")], "noun string, gender string")
    assert {tuple(r) for r in datagen.adjective_pairs(adjectives, nouns).collect()} == {("Синей мост", "Синий мост"), ("Синей поле", "Синее поле")}
    split = datagen.shuffle_split(datagen.oblique_pairs(names))
    assert 0.8 < split.filter("split = 'train'").count() / split.count() < 1
    assert datagen.subsample(pairs, 3).count() == 3


def test_reports(spark):
    cases = spark.createDataFrame([("абв", "абг"), ("аб", "абв"), ("", "")], "output string, found string")
    assert stats.character_accuracy(cases).first().accuracy == pytest.approx(4 / 6, abs=1e-6)
    meta = stats.upsert_meta(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, value string"), spark.createDataFrame([("a", "2")], "key string, value string"))
    assert [tuple(r) for r in meta.collect()] == [("a", "2"), ("b", "1")]
    answers = spark.createDataFrame([("q", -2.0, 1, 1), ("q", -1.0, 2, 1), ("p", -1.0, 3, 4)], "query string, rank double, id long, wanted long")
    assert stats.precision_at_1(answers).first().precision_at_1 == 0.5
    south, north, west, east = geo.box_around(60.0, 30.0, 10)
    assert geo.haversine_m(60, 30, north, 30) == pytest.approx(10_000, rel=0.01) and geo.haversine_m(60, 30, 60, east) == pytest.approx(10_000, rel=0.01)


def test_sorted_tables_skip(spark, tmp_path):
    df = indexed(spark)
    index.write_sorted(df, str(tmp_path / "s"), ["lat", "lon"], 2)
    plan = spark.read.parquet(str(tmp_path / "s")).filter("lat BETWEEN 50 AND 51")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat), GreaterThanOrEqual(lat" in plan


def test_streaming(spark, tmp_path):
    from placeforge.operators.extract import ELEMENTS
    from placeforge.streaming import extracting

    rows = spark.createDataFrame([(k, "node", k, 1.0, 2.0, {"addr:street": "Ƒверская", "addr:housenumber": "1"} if k else {}, None, None) for k in range(3)], ELEMENTS)
    rows.write.parquet(str(tmp_path / "in"))
    stream = extracting.stream_objects(spark.readStream.schema(ELEMENTS).parquet(str(tmp_path / "in")))
    stream = extracting.keep_first(stream.withColumn("ts", F.current_timestamp()), "ts", "1 hour", ["street", "housenumber"])
    q = stream.writeStream.format("memory").queryName("out_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.street for r in spark.sql("SELECT * FROM out_rows").collect()] == ["Тверская"]
