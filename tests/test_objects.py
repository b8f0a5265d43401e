import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from placeforge.functions import geo
from placeforge.operators import dedup, extract, infer
from placeforge.plans import build

OBJECT = "seq long, type tinyint, lat double, lon double, country string, city string, street string, housenumber string, postcode string, name string, category string"


def node(seq, tags, lat=55.0, lon=37.0, kind="node", refs=None, members=None):
    return (seq, kind, seq, lat if kind == "node" else None, lon if kind == "node" else None, tags, refs, members)


def elements(spark, *rows):
    return spark.createDataFrame(list(rows), extract.ELEMENTS)


def obj(seq, kind=0, lat=55.0, lon=37.0, country=None, city=None, street=None, housenumber=None, postcode=None, name=None, category=None):
    return (seq, kind, lat, lon, country, city, street, housenumber, postcode, name, category)


def objects(spark, *rows):
    return spark.createDataFrame(list(rows), OBJECT)


def by_seq(df, *columns):
    return {r.seq: tuple(r[c] for c in columns) for r in df.collect()}


def test_classification(spark):
    rows = elements(
        spark,
        node(1, {"addr:city": "Москва", "addr:street": "Тверская", "addr:housenumber": "1"}),
        node(2, {"addr:housenumber": "1"}),
        node(3, {}),
        node(4, {"name:ru": "Красная площадь", "historic": "monument"}),
        node(5, {"name": "Пятёрочка", "shop": "supermarket"}),
        node(6, {"name": "Red Square"}),
        node(7, {"addr:city": "А", "addr:street": "Б", "addr:housenumber": "2", "name": "Музей", "tourism": "museum"}),
        node(8, {"addr:city": "А", "name": "Форт", "historic": "fort"}),
        node(9, {"addr:city": "А", "addr:street": "Б", "addr:housenumber": "2"}, kind="relation", members=[]),
        node(10, {"type": "associatedStreet", "name": "X", "historic": "yes"}, kind="relation", members=[]),
        node(11, {"place": "hamlet", "name": "Озерки"}),
        node(12, {"addr:place": "Озерки", "addr:housenumber": "5"}),
        node(13, {"addr:town": "Т", "addr:street": "Ƒверская", "addr:housenumber": "7"}),
        node(14, {"name": "A", "name:ru": "Б", "historic": "x", "tourism": "y", "addr:town": "Ƒ"}),
        (15, "node", 15, 1.0, 1.0, None, None, None),
    )
    got = by_seq(extract.objects(rows), "type", "city", "street", "housenumber", "name", "category")
    assert got == {
        1: (0, "Москва", "Тверская", "1", None, None),
        4: (1, None, None, None, "Красная площадь", "historic"),
        7: (0, "А", "Б", "2", None, None),
        8: (1, "А", None, None, "Форт", "historic"),
        12: (0, "Озерки", "посёлок Озерки", "5", None, None),
        13: (0, "Т", "Тверская", "7", None, None),
        14: (1, "Ƒ", None, None, "Б", "historic"),
    }


def test_street_from_place_label(spark):
    rows = elements(spark, node(1, {"place": "hamlet", "name": "Озерки"}), node(2, {"addr:city": "Озерки", "addr:housenumber": "5"}), node(3, {"place": "village", "name": "Озерки"}), node(4, {"addr:street": "Мира", "addr:place": "Озерки", "addr:housenumber": "6"}))
    assert by_seq(extract.objects(rows), "street") == {2: ("посёлок Озерки",), 4: ("Мира",)}


def test_centroids(spark):
    rows = elements(
        spark, node(1, {}, 10.0, 20.0), node(2, {}, 20.0, 40.0),
        node(3, {"name": "a", "historic": "x"}, kind="way", refs=[1, 2, 1]), node(4, {}, kind="way", refs=[77]), node(5, {}, kind="way", refs=[]),
        node(6, {"name": "b", "tourism": "x"}, kind="relation", members=[("node", 2, ""), ("way", 3, ""), ("way", 4, ""), ("relation", 9, "")]), node(7, {}, kind="relation", members=None),
    )
    ways = extract.way_centroids(rows)
    assert {r.owner: (round(r.lat, 6), round(r.lon, 6)) for r in ways.collect()} == {3: (13.333333, 26.666667), 4: (0, 0), 5: (0, 0)}
    assert {r.owner: (round(r.lat, 6), round(r.lon, 6)) for r in extract.relation_centroids(rows, ways).collect()} == {6: (16.666667, 33.333333), 7: (0, 0)}
    assert set(by_seq(extract.objects(rows), "lat")) == {3, 6}


def test_inspect(spark):
    rows = elements(spark, *(node(k, {"name": f"Исаково {k}"}) for k in range(40)), node(50, {"addr:city": "Гурьевск"}))
    assert [r.seq for r in extract.inspect(rows, "Исаков").collect()] == list(range(30))
    assert [r.seq for r in extract.inspect(rows, "Гурьев").collect()] == [50]


def test_nearest_city_is_the_nearest(spark):
    r = random.Random(1)
    cities = [(f"c{k}", r.uniform(-80, 80), r.uniform(-179, 179)) for k in range(60)]
    points = [(k, r.uniform(-80, 80), r.uniform(-179, 179)) for k in range(150)]
    got = infer.nearest(spark.createDataFrame(points, "seq long, lat double, lon double"), spark.createDataFrame(cities, "city string, lat double, lon double")).collect()
    for g in got:
        want = min((round(geo.haversine_m(g.lat, g.lon, y, x)), c) for c, y, x in cities)
        assert abs(g.nearest_m - want[0]) <= 1 and (g.nearest == want[1] or g.nearest_m == want[0])


def test_nearest_city_near_poles_and_the_date_line(spark):
    r = random.Random(2)
    cities = [("p", 89.9, 10.0), ("q", -89.8, -100.0), ("d", 10.0, 179.99), ("e", 10.0, -179.5), *((f"k{k}", 50 + r.random(), 30 + r.random()) for k in range(40))]
    points = [(k, r.choice((90.0, 89.5, -89.9, 10.0, 50.5, 0.0)), r.choice((-180.0, 180.0, 179.9, 30.5, -75.0, 0.0))) for k in range(120)]
    got = infer.nearest(spark.createDataFrame(points, "seq long, lat double, lon double"), spark.createDataFrame(cities, "city string, lat double, lon double")).collect()
    assert len(got) == 120
    for g in got:
        assert abs(g.nearest_m - min(round(geo.haversine_m(g.lat, g.lon, y, x)) for _, y, x in cities)) <= 1


def test_nearest_without_candidates_or_coordinates(spark):
    none = spark.createDataFrame([], "city string, lat double, lon double")
    rows = spark.createDataFrame([(1, 5.0, 5.0), (2, None, 5.0)], "seq long, lat double, lon double")
    assert {r.seq: r.nearest for r in infer.nearest(rows, none).collect()} == {1: None, 2: None}
    one = spark.createDataFrame([("far", -60.0, -170.0)], "city string, lat double, lon double")
    assert {r.seq: r.nearest for r in infer.nearest(rows, one).collect()} == {1: "far", 2: None}


def test_fill_cities(spark):
    rows = objects(spark, obj(1, lat=50.0, city="А"), obj(2, lat=52.0, city="Б"), obj(3, lat=50.1), obj(4, lat=51.0, city=""), obj(5, kind=1, lat=51.9, name="x"))
    assert by_seq(infer.fill_cities(rows), "city") == {1: ("А",), 2: ("Б",), 3: ("А",), 4: ("А",), 5: ("Б",)}
    none = objects(spark, obj(1), obj(2, city=""))
    assert by_seq(infer.fill_cities(none), "city") == {1: (None,), 2: ("",)}


def test_typos(spark):
    def merged(**counts):
        rows = [obj(k, city=c) for k, c in enumerate(itertools.chain(*([c] * n for c, n in counts.items())))]
        return {r.city: r.n for r in infer.city_frequency(infer.merge_typos(objects(spark, *rows))).collect()}

    assert merged(Калининград=5, Калининнград=2) == {"Калининград": 7}
    assert merged(Калининград=5, Калининнград=3) == {"Калининград": 5, "Калининнград": 3}
    assert merged(аб=1, абвг=5) == {"аб": 1, "абвг": 5}
    assert merged(абв=1, абвгд=5) == {"абвгд": 6}
    # not transitive: the rarest goes to the middle one by distance
    assert merged(абвгдежз=1, абвгдежзик=3, абвгдежзиклм=9) == {"абвгдежзик": 1, "абвгдежзиклм": 12}


def test_countries(spark):
    rows = objects(spark, obj(1, city="А", country="RU"), obj(2, city="А", country="BY"), obj(3, city="А"), obj(4, city="Б", country=""), obj(5))
    assert by_seq(infer.fill_countries(rows, "DE-BY"), "country") == {1: ("RU",), 2: ("BY",), 3: ("RU",), 4: ("DE",), 5: ("DE",)}
    assert by_seq(infer.fill_countries(rows, "rus"), "country")[5] == (None,)


def test_address_dedup(spark):
    at = dict(country="Россия", city="Москва", street="Тверская", housenumber="1")
    rows = objects(spark, obj(1, **at), obj(2, lat=55.1, postcode="125009", **at), obj(3, **at | {"housenumber": "3"}), obj(4, **at | {"city": " москва "}), obj(5, **at | {"country": None}), obj(6, **at | {"country": ""}), obj(7, **at | {"country": None}), obj(8, **at | {"street": "Т  я"}), obj(9, **at | {"street": "т я"}), obj(10, **at | {"street": "т   я"}))
    assert sorted(by_seq(dedup.addresses(rows), "seq")) == [1, 3, 5, 6, 8, 10]


def test_greedy_points(spark):
    step = 80 / 111_194.9
    rows = [obj(k, 1, 55 + k * step, 37.0, name="Кафе") for k in range(3)] + [obj(10, 1, name="Ресторан"), obj(11, 1, 55.0003, 37.0003, name="Кафе"), obj(12, 1, name="кафе")]
    for small in (100, 1):
        assert sorted(r.seq for r in dedup.points(objects(spark, *rows), small).collect()) == [0, 2, 10, 12]


def test_rounds_equal_greedy(spark):
    r = random.Random(5)
    rows = [obj(k, 1, 55 + r.random() * 0.004, 37 + r.random() * 0.004, name=f"n{k % 2}") for k in range(160)]
    df = objects(spark, *rows)
    small, large = (sorted(x.seq for x in dedup.poi_keepers(df, n).collect()) for n in (1000, 1))
    assert small == large
    by = {x[0]: x for x in rows}
    for a, b in itertools.combinations(small, 2):
        if by[a][9] == by[b][9]:
            assert geo.haversine_m(by[a][2], by[a][3], by[b][2], by[b][3]) >= 100
    once = df.join(spark.createDataFrame([(s,) for s in small], "s long"), F.col("seq") == F.col("s"), "left_semi")
    assert sorted(x.seq for x in dedup.poi_keepers(once).collect()) == small


def test_greedy_equals_a_plain_walk(spark):
    r = random.Random(9)
    rows = [(k, 55 + r.random() * 0.02, 37 + r.random() * 0.02) for k in range(1500)] + [(5000 + k, 89.9999, r.uniform(-180, 180)) for k in range(50)]
    kept = []
    for k, y, x in rows:
        if not any(geo.haversine_m(y, x, v, w) < 100 for _, v, w in kept):
            kept.append((k, y, x))
    df = objects(spark, *(obj(k, 1, y, x, name="n") for k, y, x in rows))
    assert sorted(x.seq for x in dedup.poi_keepers(df).collect()) == [k for k, _, _ in kept]


def test_distances(spark):
    assert 100 < geo.haversine_m(55.7539, 37.6208, 55.7520, 37.6175) < 1000 and geo.haversine_m(1, 2, 1, 2) == 0
    row = spark.range(1).select(geo.haversine(F.lit(55.7539), F.lit(37.6208), F.lit(55.7520), F.lit(37.6175)).alias("m"), F.levenshtein(F.lit("Москва"), F.lit("Мсква")).alias("l")).first()
    assert abs(row.m - geo.haversine_m(55.7539, 37.6208, 55.7520, 37.6175)) < 1e-6 and row.l == 1


def test_build(spark):
    rows = elements(
        spark, node(1, {"addr:city": "Москва", "addr:street": "ул. Ленина", "addr:housenumber": "1", "addr:country": "RU"}), node(2, {"addr:city": "Москва", "addr:street": "улица Ленина", "addr:housenumber": "1", "addr:country": "RU"}),
        node(3, {"addr:street": "пр-т Мира", "addr:housenumber": "2"}, 55.01), node(4, {"name": "Форт", "historic": "x"}), node(5, {"name": "Форт", "historic": "x"}, 55.0001), node(6, {"name": "Форт", "historic": "x"}, 56.0),
    )
    made = build.build(rows, "RU-CFD")
    assert [(r.id, r.seq, r.city, r.country, r.street, r.name) for r in made.orderBy("id").collect()] == [(1, 1, "Москва", "RU", "улица Ленина", None), (2, 3, "Москва", "RU", "проспект Мира", None), (3, 4, "Москва", "RU", None, "Форт"), (4, 6, "Москва", "RU", None, "Форт")]
    words = spark.createDataFrame([("ленина", 5), ("мира", 5)], "term string, freq long")
    strict = build.build(rows, "RU-CFD", words, strict=True)
    assert {r.street for r in strict.filter("type = 0").collect()} == {"Улица Ленина", "улица Ленина", "Проспект Мира"} - {"улица Ленина"}


def test_model_step(spark):
    def load():
        known = {"улица Ленина": "улица Владимира Ленина", "Форт": "", "Москва": "Москва"}
        return lambda names: np.array([known.get(n, n) for n in names], dtype=object)

    rows = elements(
        spark, node(1, {"addr:city": "Москва", "addr:street": "ул. Ленина", "addr:housenumber": "1"}), node(2, {"addr:city": "Москва", "addr:street": "Мира", "addr:housenumber": ""}),
        node(4, {"name": "Форт", "historic": "x"}), node(5, {"name": "улица Ленина", "historic": "x"}, 57.0),
    )
    made = {r.seq: r for r in build.build(rows, "RU-CFD", model=load).collect()}
    assert made[1].street == "улица Владимира Ленина" and made[1].city == "Москва" and made[2].street == "Мира"
    assert made[4].name == "Форт" and made[5].name == "улица Владимира Ленина" and made[5].city == "Москва"
    plain = {r.seq: r for r in build.build(rows, "RU-CFD").collect()}
    assert plain[1].street == "улица Ленина" and plain[5].name == "улица Ленина"
