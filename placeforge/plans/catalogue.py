"""The driver catalogue: each query over the given tables and its SQL.

The given tables have no coordinates and no Cyrillic text, so places are derived from keys by the
same integer arithmetic on both sides, and names in Russian come as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, spell, stem, text
from ..functions import wordlists as W
from ..operators import datagen, dedup, extract, index, infer, search, stats
from ..sources import regions
from . import build
from .cases import CASES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lat(k: str):
    return F.lit(50.0) + (F.col(k) * 37 % 1000) / F.lit(100.0)


def lon(k: str):
    return F.lit(20.0) + (F.col(k) * 91 % 1000) / F.lit(100.0)


def places(spark, sf) -> DataFrame:
    """Customers as addresses: every fifth lacks its city, two of three their country."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("c_custkey")
    return rows.select(
        k.alias("seq"), F.lit(0).cast("tinyint").alias("type"), lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"),
        F.when(k % 3 == 0, F.col("r_name")).alias("country"), F.when(k % 5 != 0, F.col("n_name")).alias("city"), F.col("c_mktsegment").alias("street"),
        (k % 50).cast("string").alias("housenumber"), F.lit(None).cast("string").alias("postcode"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("category"),
    )


PLACES = """places AS (SELECT c_custkey AS seq, 50.0::DOUBLE + (c_custkey * 37 % 1000) / 100.0::DOUBLE AS lat, 20.0::DOUBLE + (c_custkey * 91 % 1000) / 100.0::DOUBLE AS lon,
 CASE WHEN c_custkey % 3 = 0 THEN r_name END AS country, CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS city, c_mktsegment AS street, (c_custkey % 50)::VARCHAR AS housenumber
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def points(spark, sf) -> DataFrame:
    """Parts as points of interest, a few of each name close together."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (k + 10_000_000).alias("seq"), F.lit(1).cast("tinyint").alias("type"), (F.lit(55.0) + (k * 37 % 1000) / F.lit(100000.0)).alias("lat"), (F.lit(37.0) + (k * 91 % 1000) / F.lit(100000.0)).alias("lon"),
        F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("street"), F.lit(None).cast("string").alias("housenumber"), F.lit(None).cast("string").alias("postcode"),
        F.col("p_name").alias("name"), F.when(F.col("p_type").startswith("S"), "historic").otherwise("tourism").alias("category"),
    )


POINTS = """points AS (SELECT p_partkey + 10000000 AS seq, 55.0::DOUBLE + (p_partkey * 37 % 1000) / 100000.0::DOUBLE AS lat, 37.0::DOUBLE + (p_partkey * 91 % 1000) / 100000.0::DOUBLE AS lon,
 p_name AS name, CASE WHEN p_type LIKE 'S%' THEN 'historic' ELSE 'tourism' END AS category FROM part)"""


def everything(spark, sf) -> DataFrame:
    return places(spark, sf).unionByName(points(spark, sf))


EVERYTHING = f"""{PLACES}, {POINTS}, objects AS (SELECT seq, 0 AS type, lat, lon, country, city, street, housenumber, NULL::VARCHAR AS name, NULL::VARCHAR AS category FROM places
 UNION ALL SELECT seq, 1, lat, lon, NULL, NULL, NULL, NULL, name, category FROM points)"""

HAVERSINE = "2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"
H = "pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


# -- joins and inference


@query(f"""WITH {PLACES}, city AS (SELECT city, avg(lat) AS lat, avg(lon) AS lon FROM places WHERE city IS NOT NULL GROUP BY city),
 pair AS (SELECT p.seq, c.city, {H.format(a="p.", b="c.")} AS h FROM places p, city c WHERE p.city IS NULL), dist AS (SELECT seq, city, round({HAVERSINE}) AS m FROM pair)
 SELECT seq, arg_min(city, (m, city)) AS city, min(m) AS metres FROM dist GROUP BY seq""")
def infer_city_nearest(spark, sf):
    rows = places(spark, sf)
    found = infer.nearest(rows.filter("city IS NULL"), infer.city_centroids(rows))
    return found.select("seq", F.col("nearest").alias("city"), F.col("nearest_m").alias("metres"))


@query(f"WITH {PLACES} SELECT city, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM places WHERE city IS NOT NULL GROUP BY city")
def city_centroids(spark, sf):
    return infer.city_centroids(places(spark, sf)).select("city", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query(f"WITH {PLACES} SELECT city, count(*) AS n FROM places WHERE city IS NOT NULL GROUP BY city")
def city_frequency(spark, sf):
    return infer.city_frequency(places(spark, sf))


@query(f"""WITH {PLACES}, known AS (SELECT city, arg_min(country, seq) AS country FROM places WHERE city IS NOT NULL AND country IS NOT NULL GROUP BY city)
 SELECT p.seq, coalesce(p.country, k.country, 'RU') AS country FROM places p LEFT JOIN known k ON p.city = k.city""")
def infer_country(spark, sf):
    return infer.fill_countries(places(spark, sf), "RU-CFD").select("seq", "country")


TYPOS = "typo AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN substr(p_name, 1, 3) || substr(p_name, 5) ELSE p_name END AS city FROM part)"


def misspelled(spark, sf) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100))).otherwise(name).alias("city"))


@query(f"""WITH {TYPOS}, f AS (SELECT city, count(*) AS n FROM typo GROUP BY city),
 near AS (SELECT a.city, b.city AS canonical, b.n AS m, levenshtein(a.city, b.city) AS distance FROM f a JOIN f b ON 2 * a.n < b.n
          WHERE levenshtein(a.city, b.city) = 1 OR (levenshtein(a.city, b.city) = 2 AND strlen(a.city) >= 6)),
 best AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY m DESC, canonical) AS rn FROM near)
 SELECT city, canonical, distance::INTEGER AS distance FROM best WHERE rn = 1""")
def typo_replacements(spark, sf):
    return infer.typo_replacements(infer.city_frequency(misspelled(spark, sf)))


@query(f"""WITH {TYPOS}, f AS (SELECT city, count(*) AS n FROM typo GROUP BY city),
 near AS (SELECT a.city, b.city AS canonical, b.n AS m FROM f a JOIN f b ON 2 * a.n < b.n
          WHERE levenshtein(a.city, b.city) = 1 OR (levenshtein(a.city, b.city) = 2 AND strlen(a.city) >= 6)),
 best AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY m DESC, canonical) AS rn FROM near)
 SELECT coalesce(b.canonical, t.city) AS city, count(*) AS n FROM typo t LEFT JOIN best b ON t.city = b.city AND rn = 1 GROUP BY 1""")
def merge_typo_cities(spark, sf):
    return infer.city_frequency(infer.merge_typos(misspelled(spark, sf)))


@query("""WITH k AS (SELECT *, 50.0::DOUBLE + (p_partkey * 37 % 1000) / 100.0::DOUBLE AS lat, 20.0::DOUBLE + (p_partkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM part WHERE p_partkey % 10 <> 0)
 SELECT o.o_orderkey AS owner, round(coalesce(avg(k.lat), 0), 6) AS lat, round(coalesce(avg(k.lon), 0), 6) AS lon FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) o
 JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN k ON l.l_partkey = k.p_partkey GROUP BY 1""")
def way_centroid(spark, sf):
    return extract.way_centroids(elements(spark, sf)).select("owner", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def elements(spark, sf) -> DataFrame:
    """Parts as nodes (every tenth isn't in the extract), orders as ways over them, customers as relations of their orders and of a part."""
    part, line, orders = (table(spark, sf, t) for t in ("part", "lineitem", "orders"))
    none_tags = F.lit(None).cast("map<string,string>")
    none_refs, none_members = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>")
    zero = F.lit(None).cast("double")
    nodes = part.filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("seq"), F.lit("node").alias("kind"), F.col("p_partkey").alias("id"), lat("p_partkey").alias("lat"), lon("p_partkey").alias("lon"), none_tags.alias("tags"), none_refs.alias("refs"), none_members.alias("members"))
    ways = line.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("refs")).select((F.col("l_orderkey") + 10_000_000).alias("seq"), F.lit("way").alias("kind"), F.col("l_orderkey").alias("id"), zero.alias("lat"), zero.alias("lon"), none_tags.alias("tags"), "refs", none_members.alias("members"))
    own = orders.select("o_custkey", F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"), F.lit("outer").alias("role")).alias("m"))
    one = orders.select("o_custkey").distinct().select("o_custkey", F.struct(F.lit("node").alias("type"), F.col("o_custkey").alias("ref"), F.lit("label").alias("role")).alias("m"))
    relations = own.unionByName(one).groupBy("o_custkey").agg(F.collect_list("m").alias("members")).select((F.col("o_custkey") + 20_000_000).alias("seq"), F.lit("relation").alias("kind"), F.col("o_custkey").alias("id"), zero.alias("lat"), zero.alias("lon"), none_tags.alias("tags"), none_refs.alias("refs"), "members")
    return nodes.unionByName(ways).unionByName(relations)


@query("""WITH node AS (SELECT p_partkey AS id, 50.0::DOUBLE + (p_partkey * 37 % 1000) / 100.0::DOUBLE AS lat, 20.0::DOUBLE + (p_partkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM part WHERE p_partkey % 10 <> 0),
 way AS (SELECT l_orderkey AS id, avg(lat) AS lat, avg(lon) AS lon FROM lineitem JOIN node ON l_partkey = node.id GROUP BY 1),
 found AS (SELECT o_custkey AS owner, lat, lon FROM orders JOIN way ON o_orderkey = way.id UNION ALL SELECT DISTINCT o_custkey, lat, lon FROM orders JOIN node ON o_custkey = node.id)
 SELECT o.owner, round(coalesce(avg(lat), 0) + 1e-7, 4) AS lat, round(coalesce(avg(lon), 0) + 1e-7, 4) AS lon FROM (SELECT DISTINCT o_custkey AS owner FROM orders) o LEFT JOIN found USING (owner) GROUP BY o.owner""")
def relation_centroid(spark, sf):
    rows = elements(spark, sf)
    return extract.relation_centroids(rows, extract.way_centroids(rows)).select("owner", F.round(F.col("lat") + 1e-7, 4).alias("lat"), F.round(F.col("lon") + 1e-7, 4).alias("lon"))


# -- extraction


def tagged(spark, sf) -> DataFrame:
    """Customers as nodes with tags by key: some have addresses, some names, some neither."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.col("c_custkey")
    put = lambda key, when, value: F.when(when, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(
        put("addr:city", k % 2 == 0, F.col("n_name")), put("addr:town", k % 2 == 1, F.concat(F.lit("T"), F.col("n_name"))), put("addr:street", k % 3 == 0, F.col("c_mktsegment")),
        put("addr:housenumber", k % 4 < 3, (k % 50).cast("string")), put("name", k % 13 != 0, F.col("c_name")), put("name", k % 13 == 0, F.col("n_name")),
        put("historic", k % 6 == 0, F.lit("ruins")), put("tourism", k % 7 == 0, F.lit("museum")), put("place", k % 13 == 0, F.lit("hamlet")),
    )
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(k.alias("seq"), F.lit("node").alias("kind"), k.alias("id"), lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"), tags.alias("tags"), F.lit(None).cast("array<bigint>").alias("refs"), F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>").alias("members"))


TAGGED = """tagged AS (SELECT c_custkey AS k, 50.0::DOUBLE + (c_custkey * 37 % 1000) / 100.0::DOUBLE AS lat, 20.0::DOUBLE + (c_custkey * 91 % 1000) / 100.0::DOUBLE AS lon,
 CASE WHEN c_custkey % 2 = 0 THEN n_name END AS a_city, CASE WHEN c_custkey % 2 = 1 THEN 'T' || n_name END AS a_town, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS a_street,
 CASE WHEN c_custkey % 4 < 3 THEN (c_custkey % 50)::VARCHAR END AS a_house, CASE WHEN c_custkey % 13 = 0 THEN n_name ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN 'historic' WHEN c_custkey % 7 = 0 THEN 'tourism' END AS category,
 c_custkey % 13 = 0 AS is_place FROM customer JOIN nation ON c_nationkey = n_nationkey),
 label AS (SELECT name AS place, 'посёлок' AS label FROM tagged WHERE is_place GROUP BY name),
 full_ AS (SELECT t.*, coalesce(a_city, a_town) AS city, coalesce(a_street, label || ' ' || coalesce(a_city, a_town)) AS street, (a_house IS NOT NULL OR a_street IS NOT NULL OR a_city IS NOT NULL) AS has_address
           FROM tagged t LEFT JOIN label ON coalesce(a_city, a_town) = place),
 object_ AS (SELECT *, has_address AND street IS NOT NULL AND a_house IS NOT NULL AS is_address FROM full_)"""


@query(f"WITH {TAGGED} SELECT k AS seq, CASE WHEN is_address THEN 0 ELSE 1 END AS type, city, CASE WHEN is_address THEN street END AS street, CASE WHEN is_address THEN a_house END AS housenumber, CASE WHEN NOT is_address THEN name END AS name, CASE WHEN NOT is_address THEN category END AS category FROM object_ WHERE is_address OR category IS NOT NULL")
def extract_objects(spark, sf):
    return extract.objects(tagged(spark, sf)).select("seq", F.col("type").cast("int").alias("type"), "city", "street", "housenumber", "name", "category")


@query(f"WITH {TAGGED} SELECT place, label FROM label")
def place_types(spark, sf):
    return extract.place_types(tagged(spark, sf))


@query("SELECT 'node' AS kind, count(*) AS n FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'way', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'relation', count(DISTINCT o_custkey) FROM orders")
def element_counts(spark, sf):
    return extract.element_counts(elements(spark, sf))


@query("SELECT c_custkey AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_custkey % 2 = 0 AND contains(n_name, 'NATION_1')) OR (c_custkey % 2 = 1 AND FALSE) OR (c_custkey % 13 = 0 AND contains(n_name, 'NATION_1')) ORDER BY seq LIMIT 30")
def inspect_elements(spark, sf):
    return extract.inspect(tagged(spark, sf), "NATION_1").select("seq")


KINDS = sorted(W.PLACE_LABELS)


@query("SELECT p_partkey, CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN '{W.PLACE_LABELS[kind]}'" for k, kind in enumerate(KINDS)) + " ELSE 'СНТ' END AS label FROM part")
def place_label_lookup(spark, sf):
    k = F.col("p_partkey") % 11
    kind = F.try_element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int"))
    tags = F.when(k < len(KINDS), F.create_map(F.lit("place"), kind)).otherwise(F.create_map(F.lit("landuse"), F.lit("allotments")))
    return table(spark, sf, "part").select("p_partkey", text.place_label(tags).alias("label"))


# -- deduplication


@query("""WITH k AS (SELECT *, replace(lower(trim(o_orderpriority || '  ' || o_orderstatus)), '  ', ' ') AS street FROM orders)
 SELECT min(o_orderkey) AS seq FROM k GROUP BY street, o_custkey, o_orderstatus""")
def dedup_address(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.lit(None).cast("string").alias("country"), F.col("o_orderstatus").alias("city"), F.concat_ws("  ", "o_orderpriority", "o_orderstatus").alias("street"), F.col("o_custkey").cast("string").alias("housenumber"))
    return dedup.addresses(rows).select("seq")


@query(f"""WITH RECURSIVE {POINTS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS rn FROM points),
 walk AS (SELECT name, 1::BIGINT AS rn, [struct_pack(seq := seq, lat := lat, lon := lon)] AS kept FROM ordered WHERE rn = 1
  UNION ALL SELECT w.name, o.rn, CASE WHEN len(list_filter(w.kept, lambda k: 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(o.lat - k.lat) / 2), 2) + cos(radians(k.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - k.lon) / 2), 2))) < 100)) = 0
  THEN list_append(w.kept, struct_pack(seq := o.seq, lat := o.lat, lon := o.lon)) ELSE w.kept END FROM walk w JOIN ordered o ON o.name = w.name AND o.rn = w.rn + 1),
 last AS (SELECT name, arg_max(kept, rn) AS kept FROM walk GROUP BY name) SELECT k.seq FROM last, unnest(kept) AS t(k)""")
def dedup_poi_greedy(spark, sf):
    return dedup.poi_keepers(points(spark, sf))


@query(r"SELECT doc_id, md5(replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '  ', ' ')) AS key FROM documents")
def dedup_key_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.dedup_key(F.col("text")).cast("binary")).alias("key"))


# -- names


def over_parts(spark, sf, rows: list[tuple], function, make=lambda given: given) -> DataFrame:
    """Parts, each with the given input of its turn (``make`` may add to it), and what the function makes of it."""
    given = F.element_at(F.array(*(F.lit(r[0]) for r in rows)), (F.col("p_partkey") % len(rows) + 1).cast("int"))
    asked = table(spark, sf, "part").select("p_partkey", make(given).alias("input"))
    return asked.withColumn("output", function(F.col("input")))


def over_parts_sql(rows: list[tuple], made: str = "{}") -> str:
    """The same with the given outputs; ``made`` adds to inputs and outputs."""
    numbered = ", ".join(f"({k}, '{i}', '{o}')" for k, (i, o) in enumerate(rows))
    return f"SELECT p_partkey, {made.format('input')} AS input, {made.format('output')} AS output FROM part JOIN (VALUES {numbered}) AS given(k, input, output) ON p_partkey % {len(rows)} = k"


THEN_NAME, AFTER_NAME = "{} || ' ' || p_name", "p_name || ' ' || {}"


def then_name(given):
    return F.concat_ws(" ", given, "p_name")


def after_name(given):
    return F.concat_ws(" ", "p_name", given)


@query(over_parts_sql([(c[0], c[1]) for c in CASES]))
def normalize_name(spark, sf):
    return over_parts(spark, sf, CASES, text.normalize_name)


@query(over_parts_sql([(c[0], c[0] if c[2] == "adjective" else c[1]) for c in CASES]))
def normalize_rule_based(spark, sf):
    return over_parts(spark, sf, CASES, text.normalize_rule_based)


EXPANDED = [("ул Ленина", "улица Ленина"), ("Ул Ленина", "Улица Ленина"), ("Пр Мира", "Проспект Мира"), ("пр-ту Мира", "проспект Мира"), ("  ", "  "), ("  мкр.  Северный ", "микрорайон  Северный"), ("Москва ", "Москва ")]
OBLIQUE = [("улицы Ленина", "улица Ленина"), ("Улицы   Ленина", "Улица Ленина"), ("Ленинский проспекта", "Ленинский проспект"), ("Moscow street", "Moscow street")]
REPAIRED = [("Московский проспекту", "Московский проспект"), ("Тверская улицы", "Тверская улица"), ("по улице", "по улица"), ("Московский проспект съезду 3", "Московский проспект съезд 3"), ("Большое Исаково", "Большое Исаково")]
AGREED = [("Калининградской улица", "Калининградская улица"), ("Калининградской зоопарк", "Калининградский зоопарк"), ("Большой проспект", "Большый проспект"), ("Весенней  улица", "Весенняя улица"), ("Синей шоссе", "Синее шоссе"), ("Мира", "Мира")]
CASED = [("УЛИЦА ПУШКИНА", "улица Пушкина"), ("проспект МИРА", "проспект Мира"), ("красная площадь", "Красная площадь"), ("МОСКВА", "Москва"), ("санкт-петербург", "Санкт-петербург"), ("", ""), ("переулок Сивцев Вражек", "переулок Сивцев Вражек")]
BROKEN = [("Ƒверская", "Тверская"), ("Ƒурская", "Курская"), ("Ƒолгая", "Долгая"), ("Мира", "Мира")]
STEMS = [("москва", "москв"), ("тверская", "тверск"), ("красная", "красн"), ("площадь", "площад"), ("улица", "улиц"), ("важнейший", "важн")]
SIZES = [("828 MB", 828.0), ("38.4 MB", 38.4), ("1.2 GB", 1228.8), ("12&nbsp;MB", 12.0), ("large", 0.0)]


FORMS = list(dict.fromkeys(W.ABBREVIATIONS))


@query("WITH form AS (" + literal(FORMS, "form, full_") + f") SELECT p_partkey, form || ' ' || p_name AS input, full_ || ' ' || p_name AS output FROM part JOIN (SELECT *, row_number() OVER () - 1 AS k FROM form) f ON p_partkey % {len(FORMS)} = f.k")
def expand_abbreviations(spark, sf):
    form = F.element_at(F.array(*(F.lit(f) for f, _ in FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", form, "p_name").alias("input"))
    return rows.withColumn("output", text.expand_abbreviations(F.col("input")))


@query(over_parts_sql(OBLIQUE, THEN_NAME))
def oblique_types(spark, sf):
    return over_parts(spark, sf, OBLIQUE, text.normalize_oblique, then_name)


@query(over_parts_sql(REPAIRED, THEN_NAME))
def street_types_case(spark, sf):
    return over_parts(spark, sf, REPAIRED, text.normalize_street_types_case, then_name)


@query(over_parts_sql(AGREED, AFTER_NAME))
def adjective_agreement(spark, sf):
    return over_parts(spark, sf, AGREED, text.fix_adjective_agreement, after_name)


@query(over_parts_sql(CASED, "trim({} || ' ' || p_partkey)"))
def normalize_case(spark, sf):
    return over_parts(spark, sf, CASED, text.normalize_case, lambda given: F.trim(F.concat_ws(" ", given, F.col("p_partkey").cast("string"))))


@query(over_parts_sql(BROKEN, THEN_NAME))
def normalize_chars(spark, sf):
    return over_parts(spark, sf, BROKEN, text.normalize_chars, then_name)


@query(over_parts_sql(STEMS))
def stem_words(spark, sf):
    return over_parts(spark, sf, STEMS, stem.stem_udf)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 0.0 WHEN 2 THEN (o_orderkey % 77) * 1024.0 ELSE (o_orderkey % 9000) / 8.0 END::DOUBLE AS output FROM orders")
def size_parse(spark, sf):
    k = F.col("o_orderkey")
    amount = ((k % 9000) / 8).cast("string")
    said = F.when(k % 4 == 3, "large").when(k % 4 == 2, F.concat((k % 77).cast("string"), F.lit(" GB"))).when(k % 4 == 1, F.concat(amount, F.lit("&nbsp;MB"))).otherwise(F.concat(amount, F.lit(" MB")))
    return table(spark, sf, "orders").select("o_orderkey", text.size_mb(said).alias("output"))


DICTIONARY = [("москва", 90), ("мост", 50), ("места", 70), ("улица", 80), ("дорога", 60)]
SPELLED = [("Мосва дарога", "Москва дорога"), ("Мсоква", "Москва"), ("Гурьевск ул", "Гурьевск ул"), ("Street улца", "Street улица")]


@query(over_parts_sql(SPELLED, THEN_NAME))
def spell_correct(spark, sf):
    rows = over_parts(spark, sf, SPELLED, lambda c: c, then_name)
    return spell.correct(rows, "output", spark.createDataFrame(DICTIONARY, "term string, freq long"), "p_partkey")


@query(f"""WITH term AS (SELECT p_name AS term, count(*) AS freq FROM part GROUP BY 1), {TYPOS}, asked AS (SELECT DISTINCT city AS word FROM typo),
 near AS (SELECT word, term, freq, damerau_levenshtein(word, term) AS d FROM asked, term WHERE damerau_levenshtein(word, term) <= 2),
 best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, freq DESC, term) AS rn FROM near) SELECT word, term, d::INTEGER AS distance FROM best WHERE rn = 1""")
def spell_suggestions(spark, sf):
    known = table(spark, sf, "part").groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("freq"))
    return spell.suggestions(misspelled(spark, sf).withColumnRenamed("city", "word"), known)


# -- full-text search

TOKENS = f"""token AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), '{text.ACCENTS}', '{text.PLAIN}'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS term FROM documents),
 posting AS (SELECT doc_id, term, count(*) AS tf FROM token GROUP BY ALL)"""
TERMS = ["moron", "th"]


def document_postings(spark, sf) -> DataFrame:
    return search.postings(table(spark, sf, "documents"), ["text"], "doc_id")


def scanned_documents(spark, sf) -> tuple[DataFrame, DataFrame]:
    return search.scanned(table(spark, sf, "documents"), ["text"], TERMS, "doc_id")


@query(f"WITH {TOKENS} SELECT term, count(*) AS docs, sum(tf)::BIGINT AS uses FROM posting GROUP BY term")
def fts_terms(spark, sf):
    return document_postings(spark, sf).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS n_tokens FROM posting GROUP BY doc_id")
def fts_postings(spark, sf):
    return document_postings(spark, sf).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("n_tokens"))


@query(f"WITH {TOKENS} SELECT doc_id FROM posting GROUP BY doc_id HAVING bool_or(starts_with(term, '{TERMS[0]}')) AND bool_or(starts_with(term, '{TERMS[1]}'))")
def fts_match_and(spark, sf):
    return search.match_all(scanned_documents(spark, sf)[0], TERMS)


RANKED = f"""{TOKENS}, size AS (SELECT doc_id, sum(tf)::DOUBLE AS n FROM posting GROUP BY doc_id), corpus AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM size),
 asked AS (SELECT * FROM (VALUES (0, '{TERMS[0]}'), (1, '{TERMS[1]}')) AS t(term_no, prefix)),
 hit AS (SELECT doc_id, term_no, sum(tf)::DOUBLE AS f FROM posting JOIN asked ON starts_with(term, prefix) GROUP BY ALL), spread AS (SELECT term_no, count(*)::DOUBLE AS n FROM hit GROUP BY term_no),
 part_ AS (SELECT h.doc_id, CASE WHEN ln((docs - s.n + 0.5) / (s.n + 0.5)) > 0 THEN ln((docs - s.n + 0.5) / (s.n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * z.n / mean)) AS p
          FROM hit h JOIN spread s USING (term_no) JOIN size z ON z.doc_id = h.doc_id, corpus),
 ranked AS (SELECT doc_id, -sum(p) AS rank FROM part_ GROUP BY doc_id HAVING count(*) = 2)"""


@query(f"WITH {RANKED} SELECT doc_id, round(rank, 6) AS rank FROM ranked ORDER BY ranked.rank, doc_id LIMIT 20")
def fts_bm25_top20(spark, sf):
    return search.top(search.bm25(*scanned_documents(spark, sf), TERMS)).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {RANKED}, place AS (SELECT doc_id AS id, source AS category, 50.0::DOUBLE + (doc_id * 37 % 1000) / 100.0::DOUBLE AS lat, 20.0::DOUBLE + (doc_id * 91 % 1000) / 100.0::DOUBLE AS lon FROM documents)
 SELECT id, category, lat, lon, round(rank, 6) AS rank FROM ranked JOIN place ON id = doc_id WHERE lat BETWEEN 52 AND 58 AND lon BETWEEN 21 AND 29 ORDER BY ranked.rank, id LIMIT 20""")
def fts_bbox(spark, sf):
    posted, sizes = scanned_documents(spark, sf)
    objects = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), lat("doc_id").alias("lat"), lon("doc_id").alias("lon"))
    return search.search(objects, posted, sizes, " ".join(TERMS), box=(52, 58, 21, 29), stemmed=False).withColumn("rank", F.round("rank", 6))


@query(f"""WITH {RANKED} SELECT doc_id AS id, source AS category, round(rank, 6) AS rank FROM ranked JOIN documents USING (doc_id) WHERE source = 'src0' ORDER BY ranked.rank, id LIMIT 20""")
def fts_category(spark, sf):
    posted, sizes = scanned_documents(spark, sf)
    objects = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return search.search(objects, posted, sizes, " ".join(TERMS), category="src0", stemmed=False).withColumn("rank", F.round("rank", 6))


# -- boxes, distances, sorted lookups

SUPPLIERS = "s AS (SELECT s_suppkey AS id, s_name AS name, 50.0::DOUBLE + (s_suppkey * 37 % 1000) / 100.0::DOUBLE AS lat, 20.0::DOUBLE + (s_suppkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM supplier)"


def suppliers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"))


@query(f"WITH {SUPPLIERS} SELECT * FROM s WHERE lat BETWEEN 52 AND 57 AND lon BETWEEN 22 AND 27")
def bbox_filter(spark, sf):
    return suppliers(spark, sf).filter(geo.in_box(F.col("lat"), F.col("lon"), 52, 57, 22, 27))


@query(f"WITH {SUPPLIERS} SELECT id, round((lat - 55.1) * (lat - 55.1) + (lon - 25.2) * (lon - 25.2), 9) AS d2 FROM s ORDER BY (lat - 55.1) * (lat - 55.1) + (lon - 25.2) * (lon - 25.2), id LIMIT 20")
def distance_topk(spark, sf):
    return search.nearest_points(suppliers(spark, sf), 55.1, 25.2).select("id", F.round("d2", 9).alias("d2"))


@query(f"WITH {SUPPLIERS}, h AS (SELECT {H.format(a='s.', b='c.')} AS h FROM s, (SELECT 55.1::DOUBLE AS lat, 25.2::DOUBLE AS lon) c), d AS (SELECT {HAVERSINE} AS m FROM h) SELECT count(*) AS n, round(sum(round(m))) AS metres FROM d WHERE m < 200000")
def radius_count(spark, sf):
    south, north, west, east = geo.box_around(55.1, 25.2, 210)
    rows = suppliers(spark, sf).filter(geo.in_box(F.col("lat"), F.col("lon"), south, north, west, east)).withColumn("m", geo.haversine(F.col("lat"), F.col("lon"), F.lit(55.1), F.lit(25.2)))
    return rows.filter("m < 200000").agg(F.count("*").alias("n"), F.round(F.sum(F.round("m"))).alias("metres"))


@query(f"WITH {POINTS} SELECT name, count(*) AS n FROM points WHERE starts_with(lower(name), 'red') GROUP BY name")
def prefix_name_lookup(spark, sf):
    return index.find_name(index.named_index(index.records(points(spark, sf))), "Red").groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {PLACES} SELECT p.seq FROM places p JOIN places q ON q.seq = 7 AND p.city = q.city AND p.street = q.street AND p.housenumber = q.housenumber")
def address_point_lookup(spark, sf):
    rows = places(spark, sf)
    q = rows.filter("seq = 7").first()
    return index.find_address(index.address_index(index.records(rows)), q.city.upper(), q.street.lower(), q.housenumber).select("seq")


RECORDS = f"{EVERYTHING}, rec AS (SELECT *, row_number() OVER (ORDER BY lat, lon, seq) - 1 AS record_idx FROM objects)"


@query(f"WITH {RECORDS} SELECT record_idx, type, round(lat::FLOAT::DOUBLE, 5) AS lat, round(lon::FLOAT::DOUBLE, 5) AS lon, CASE category WHEN 'tourism' THEN 2 WHEN 'historic' THEN 4 ELSE 0 END AS category_code FROM rec")
def record_block(spark, sf):
    return index.records(everything(spark, sf)).select("record_idx", F.col("type").cast("int").alias("type"), F.round(F.col("lat32").cast("double"), 5).alias("lat"), F.round(F.col("lon32").cast("double"), 5).alias("lon"), "category_code")


@query(f"WITH {RECORDS} SELECT lower(name) AS key, record_idx FROM rec WHERE type = 1")
def named_index(spark, sf):
    return index.named_index(index.records(everything(spark, sf))).select("key", "record_idx")


@query(f"WITH {RECORDS} SELECT lower(coalesce(city, '')) AS city_key, lower(street) AS street_key, housenumber AS housenumber_key, record_idx FROM rec WHERE type = 0")
def address_index(spark, sf):
    return index.address_index(index.records(everything(spark, sf))).select("city_key", "street_key", "housenumber_key", "record_idx")


POOL = f"""{EVERYTHING}, used AS (SELECT seq, unnest(CASE WHEN type = 0 THEN [city, street, housenumber, country, NULL] ELSE [country, city, name] END) AS value, unnest(CASE WHEN type = 0 THEN [0, 1, 2, 3, 4] ELSE [0, 1, 2] END) AS pos FROM objects),
 first AS (SELECT value, min((seq, pos)) AS f FROM used WHERE value <> '' GROUP BY value), pool AS (SELECT row_number() OVER (ORDER BY f) AS idx, value FROM first UNION ALL SELECT 0, '')"""


@query(f"WITH {POOL} SELECT idx, value FROM pool")
def string_pool(spark, sf):
    return index.string_pool(everything(spark, sf))


@query(f"WITH {POOL} SELECT value FROM pool WHERE contains(lower(value), 'widget')")
def pool_substring_search(spark, sf):
    return index.find_pool(index.string_pool(everything(spark, sf)), "Widget").select("value")


# -- reports


@query(f"WITH {EVERYTHING} SELECT count(*) AS objects, count(*) FILTER (type = 0) AS addresses, count(*) FILTER (type = 1) AS named FROM objects")
def object_counts(spark, sf):
    return stats.object_counts(everything(spark, sf))


@query(f"WITH {POINTS} SELECT category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM points GROUP BY category")
def category_histogram(spark, sf):
    return stats.category_histogram(points(spark, sf))


@query(f"WITH {PLACES} SELECT coalesce(city, '(пусто)') AS city, count(*) AS n FROM places GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30")
def city_stats_top30(spark, sf):
    return stats.top_cities(places(spark, sf))


@query(f"WITH {PLACES} SELECT city, count(*) AS n_addresses, count(DISTINCT street) AS n_streets FROM places WHERE city <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def city_street_stats(spark, sf):
    return stats.city_streets(places(spark, sf))


@query(f"WITH {PLACES} SELECT city, street, count(*) AS n_houses FROM places WHERE street <> '' AND city IS NOT NULL GROUP BY ALL ORDER BY n_houses DESC, city, street LIMIT 10")
def street_houses_top10(spark, sf):
    return stats.street_houses(places(spark, sf).filter("city IS NOT NULL"))


@query("SELECT p_partkey AS seq FROM part WHERE CASE WHEN p_partkey % 9 = 0 THEN 'NATION_' || (p_partkey % 40) ELSE p_name END IN (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def poi_is_city(spark, sf):
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("NATION_"), (F.col("p_partkey") % 40).cast("string"))).otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), name.alias("name"))
    n = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("city"))
    return stats.points_named_as_cities(rows, n).select("seq")


@query("SELECT n_name AS key, coalesce(r_name, n_regionkey::VARCHAR) AS value FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def meta_last_wins(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    first = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    second = n.join(r, n.n_nationkey == r.r_regionkey).select(F.col("n_name").alias("key"), F.col("r_name").alias("value"))
    return stats.upsert_meta(first, second)


@query("SELECT replace(lower(n_name), '_', ' ') AS name, 'world/' || lower(replace(n_name, '_', '-')) AS subpath, (n_nationkey + 1) * 1024.0::DOUBLE AS size_mb FROM nation WHERE n_regionkey <> 0")
def region_table_parse(spark, sf):
    slug = F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit("-")))
    parent = F.when(F.col("n_regionkey") == 0, "other/deep").otherwise("world")
    link = F.concat(F.lit('<td><a href="'), parent, F.lit("/"), slug, F.lit('-latest.osm.pbf" class="x">[.osm.pbf]</a></td><td>('), (F.col("n_nationkey") + 1).cast("string"), F.lit("&nbsp;GB)</td>"))
    return regions.region_table(table(spark, sf, "nation").select(link.alias("html")), "world")


def capital(c: str) -> str:
    """SQL: the first word begins with a capital, its other letters are lowered; later words stay."""
    return f"upper({c}[1]) || lower(split_part({c}, ' ', 1)[2:]) || {c}[len(split_part({c}, ' ', 1)) + 1:]"


#: No two places of customers are 100 m apart or less but equal ones, so a point of a name and place goes if it isn't the first.
@query(f"""WITH {TAGGED.replace("c_custkey % 2 = 0 THEN", "c_custkey % 2 = 0 AND c_custkey % 17 <> 0 THEN").replace("c_custkey % 2 = 1 THEN", "c_custkey % 2 = 1 AND c_custkey % 17 <> 0 THEN")},
 found AS (SELECT k AS seq, CASE WHEN is_address THEN 0 ELSE 1 END AS type, lat, lon, city, CASE WHEN is_address THEN street END AS street, CASE WHEN is_address THEN a_house END AS housenumber,
  CASE WHEN NOT is_address THEN name END AS name, CASE WHEN NOT is_address THEN category END AS category FROM object_ WHERE is_address OR category IS NOT NULL),
 centre AS (SELECT city, avg(lat) AS lat, avg(lon) AS lon FROM found WHERE city IS NOT NULL GROUP BY city),
 pair AS (SELECT p.seq, c.city, {H.format(a="p.", b="c.")} AS h FROM found p, centre c WHERE p.city IS NULL),
 closest AS (SELECT seq, arg_min(city, (round({HAVERSINE}), city)) AS near_city FROM pair GROUP BY seq),
 filled AS (SELECT found.* REPLACE (coalesce(city, near_city) AS city) FROM found LEFT JOIN closest USING (seq)),
 f AS (SELECT city, count(*) AS n FROM filled GROUP BY city),
 near AS (SELECT a.city, b.city AS canonical, b.n AS m FROM f a JOIN f b ON 2 * a.n < b.n WHERE levenshtein(a.city, b.city) = 1 OR (levenshtein(a.city, b.city) = 2 AND strlen(a.city) >= 6)),
 fix AS (SELECT city AS typo, arg_min(canonical, (-m, canonical)) AS canonical FROM near GROUP BY city),
 named AS (SELECT seq, type, lat, lon, 'RU' AS country, coalesce(canonical, city) AS city, {capital("street")} AS street, housenumber, {capital("name")} AS name, category FROM filled LEFT JOIN fix ON city = typo),
 kept AS (SELECT min(seq) AS seq FROM named WHERE type = 0 GROUP BY lower(city), lower(street), housenumber UNION ALL SELECT min(seq) FROM named WHERE type = 1 GROUP BY name, lat, lon)
 SELECT row_number() OVER (ORDER BY seq) AS id, seq, type, country, city, street, housenumber, name, category FROM named JOIN kept USING (seq)""")
def build_objects(spark, sf):
    """The whole chain over customers as elements, of which every seventeenth names no city."""
    rows = tagged(spark, sf)
    no_city = F.map_filter("tags", lambda key, _: ~key.isin("addr:city", "addr:town"))
    rows = rows.withColumn("tags", F.when(F.col("seq") % 17 == 0, no_city).otherwise(F.col("tags")))
    return build.build(rows, "RU-CFD").select("id", "seq", F.col("type").cast("int").alias("type"), "country", "city", "street", "housenumber", "name", "category")


NAMES = "name AS (SELECT DISTINCT p_name AS name FROM part)"
ABBR = ", ".join(f"('{a}', '{f}')" for a, f in W.ABBREVIATIONS)


def part_names(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()


@query(f"WITH {NAMES}, form AS (SELECT * FROM (VALUES {ABBR}) t(form, full_)), dot AS (SELECT * FROM (VALUES (' '), ('. '), ('.')) t(dot)) SELECT form || dot || name AS input, full_ || ' ' || name AS output FROM name, form, dot")
def pairs_abbreviation(spark, sf):
    return datagen.abbreviation_pairs(part_names(spark, sf))


@query(f"WITH {NAMES}, form AS (SELECT * FROM (VALUES {', '.join(f"('{o}', '{f}')" for f, forms in W.OBLIQUE_PAIRS.items() for o in forms)}) t(form, full_)) SELECT form || ' ' || name AS input, full_ || ' ' || name AS output FROM name, form UNION ALL SELECT name || ' ' || form, name || ' ' || full_ FROM name, form")
def pairs_oblique(spark, sf):
    return datagen.oblique_pairs(part_names(spark, sf))


@query(f"WITH {NAMES}, form AS (SELECT * FROM (VALUES {ABBR}) t(form, full_)), s AS (SELECT * FROM (VALUES {', '.join(f"('{s}')" for s in W.OBLIQUE_SUFFIXES)}) t(s)), dot AS (SELECT * FROM (VALUES (''), ('.')) t(dot)) SELECT rtrim(form, '.') || s || dot || ' ' || name AS input, full_ || ' ' || name AS output FROM name, form, s, dot WHERE dot = '' OR contains(form, '.')")
def pairs_suffixed(spark, sf):
    return datagen.suffixed_pairs(part_names(spark, sf))


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


ADJECTIVES = f"""adjective AS (SELECT * FROM (VALUES {values([(g, o, n) for g, rows in W.ADJECTIVE_PAIRS.items() for o, n in rows])}) t(gender, oblique, nominative)),
 noun AS (SELECT * FROM (VALUES {values([(g, n) for g, rows in W.PAIR_NOUNS.items() for n in rows])}) t(gender, noun)),
 agreed AS (SELECT oblique || ' ' || noun AS input, nominative || ' ' || noun AS output FROM adjective JOIN noun USING (gender) UNION ALL SELECT * FROM (VALUES {values(W.AGREED_PAIRS)}) t(input, output))"""
UNCHANGED = f"""same AS (SELECT kind || ' ' || name AS input FROM name, (VALUES {values([(t,) for t in W.PAIR_TYPES])}) t(kind) UNION ALL SELECT * FROM (VALUES {values([(p,) for p in W.PAIR_PLACES])}) t(place)),
 noop AS (SELECT input, input AS output FROM same)"""


@query(f"WITH {ADJECTIVES} SELECT input, output FROM agreed")
def pairs_adjective(spark, sf):
    return datagen.every_pair(part_names(spark, sf)).filter("kind = 'adjective_agreement'").select("input", "output")


@query(f"WITH {NAMES}, {UNCHANGED} SELECT input, output FROM noop")
def pairs_unchanged(spark, sf):
    return datagen.every_pair(part_names(spark, sf)).filter("kind = 'noop'").select("input", "output")


@query(f"""WITH {NAMES}, {ADJECTIVES}, {UNCHANGED}, every_ AS (SELECT 'abbreviation' AS kind, * FROM ({SQL["pairs_abbreviation"]}) UNION ALL SELECT 'oblique', * FROM ({SQL["pairs_oblique"]})
 UNION ALL SELECT 'abbreviated_oblique', * FROM ({SQL["pairs_suffixed"]}) UNION ALL SELECT 'adjective_agreement', * FROM agreed UNION ALL SELECT 'noop', * FROM noop)
 SELECT kind || '_pairs' AS key, count(*) AS n FROM every_ GROUP BY kind UNION ALL SELECT 'total_pairs', count(*) FROM (SELECT DISTINCT input, output FROM every_)""")
def dataset_stats(spark, sf):
    """Counts of the whole data set; those of its splits depend on a hash that SQL lacks."""
    pairs = datagen.every_pair(part_names(spark, sf))
    return datagen.dataset_stats(pairs, datagen.dataset(pairs)).filter("key NOT IN ('train_pairs', 'val_pairs')")


@query("SELECT o_orderpriority AS input, o_orderstatus AS output, min(o_orderkey) AS first FROM orders GROUP BY ALL")
def pairs_dedup_first(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("input"), F.col("o_orderstatus").alias("output"), "o_orderkey")
    return datagen.distinct_first(rows, F.col("o_orderkey"))


@query("SELECT source AS category, count(*) AS n, sum((quality = toxic)::INT)::BIGINT AS matches, round(avg((quality = toxic)::INT), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)")
def eval_report_rollup(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("category")), "doc_id")
    return stats.match_report(rows, "quality", "toxic")


@query("WITH p AS (SELECT p_name AS a, substr(p_name, 1, 4) || 'x' || substr(p_name, 6) AS b FROM part) SELECT round(sum(len(list_filter(range(1, 1 + greatest(len(a), len(b))), lambda i: i <= len(a) AND i <= len(b) AND a[i] = b[i]))) / sum(greatest(len(a), len(b))), 6) AS accuracy FROM p")
def char_accuracy(spark, sf):
    name = F.col("p_name")
    rows = table(spark, sf, "part").select(name.alias("output"), F.concat(F.substring(name, 1, 4), F.lit("x"), F.substring(name, 6, 100)).alias("found"))
    return stats.character_accuracy(rows)


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("SELECT o_orderkey, strftime(DATE '1970-01-01' + (o_orderkey % 40000)::INTEGER, '%Y-%m-%d') AS day FROM orders")
def days_to_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("o_orderkey") % 40000).cast("int")), "yyyy-MM-dd").alias("day"))


STEMS_OF_PATHS = [("central-fed-district-latest.osm.pbf", "central-fed-district"), ("/data/russia-latest.osm.pbf", "russia"), ("moscow.osm.pbf", "moscow")]
PROTECTED = [("проспект", True), ("исаково", True), ("диск", True), ("оренбург", True), ("дом", False)]
STRICT = [("ул Ленина", "Улица Ленина"), ("Тверской бульвар", "Тверский бульвар"), ("п. Озерки", "Переулок Озерки"), ("Ростов-на-Дону", "Ростов-на-дону"), ("Калининградской зоопарк", "Калининградский зоопарк")]
CODES = [("amenity", 1), ("tourism", 2), ("shop", 3), ("historic", 4), ("leisure", 5), ("office", 6), ("boundary", 7), ("admin_level:4", 7), ("highway", 8), ("railway", 9), ("aeroway", 10), ("waterway", 11), ("natural", 12), ("other", 0)]


@query(r"""WITH path AS (SELECT '/data/' || replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN '-latest.osm.pbf' WHEN 1 THEN '.osm.pbf' WHEN 2 THEN '.osm' ELSE '-latest.osm' END AS input, p_partkey FROM part)
 SELECT p_partkey, input, replace(regexp_extract(input, '([^/]*)$', 1)[:regexp_extract(input, '([^/]*)$', 1).strpos('.') - 1], '-latest', '') AS output FROM path""")
def output_stem(spark, sf):
    k = F.col("p_partkey") % 4
    end = F.when(k == 0, "-latest.osm.pbf").when(k == 1, ".osm.pbf").when(k == 2, ".osm").otherwise("-latest.osm")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/data/"), F.replace("p_name", F.lit(" "), F.lit("-")), end).alias("input"))
    return rows.withColumn("output", text.output_stem(F.col("input")))


@query("WITH word AS (" + literal([(w,) for w, _ in PROTECTED], "word") + f"), made AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN word ELSE p_name || word END AS input, p_partkey % 2 = 0 AS whole, word FROM part JOIN (SELECT *, row_number() OVER () - 1 AS k FROM word) w ON p_partkey % {len(PROTECTED)} = w.k)"
       " SELECT p_partkey, input, CASE word WHEN 'дом' THEN FALSE WHEN 'проспект' THEN whole ELSE TRUE END AS output FROM made")
def protected_words(spark, sf):
    k = F.col("p_partkey")
    word = F.element_at(F.array(*(F.lit(w) for w, _ in PROTECTED)), (k % len(PROTECTED) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.when(k % 2 == 0, word).otherwise(F.concat("p_name", word)).alias("input"))
    return rows.withColumn("output", text.is_protected_word(F.col("input")))


@query(over_parts_sql(STRICT))
def normalize_name_strict(spark, sf):
    return over_parts(spark, sf, STRICT, lambda c: text.normalize_name(c, strict=True))


@query("WITH code AS (" + literal(CODES, "input, output") + f") SELECT p_partkey, c.input, c.output::INTEGER AS output FROM part JOIN (SELECT *, row_number() OVER () - 1 AS k FROM code) c ON p_partkey % {len(CODES)} = c.k")
def category_codes(spark, sf):
    category = F.element_at(F.array(*(F.lit(c) for c, _ in CODES)), (F.col("p_partkey") % len(CODES) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", category.alias("input")).withColumn("output", text.category_code(F.col("input")))


@query(f"WITH {POINTS}, rec AS (SELECT *, row_number() OVER (ORDER BY lat, lon, seq) AS i FROM points) SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM rec WHERE name = (SELECT name FROM points WHERE seq = 10000001) ORDER BY i LIMIT 1")
def poi_coordinates(spark, sf):
    """The first record of an exact name."""
    rows = points(spark, sf)
    name = rows.filter("seq = 10000001").first().name
    found = index.find_name(index.named_index(index.records(rows)), name, prefix=False)
    return found.orderBy("record_idx").limit(1).select("name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"WITH {PLACES} SELECT seq, street, housenumber FROM places WHERE lower(city) = 'nation_3' ORDER BY seq LIMIT 5")
def inspect_city(spark, sf):
    return stats.inspect_city(places(spark, sf), "Nation_3")[1].select("seq", "street", "housenumber")


@query(f"WITH {PLACES} SELECT seq, concat_ws(', ', country, city, street, housenumber) AS line FROM places")
def address_lines(spark, sf):
    rows = places(spark, sf)
    return rows.select("seq", search.address_line(rows).alias("line"))


TRIGRAMS = "list_distinct(list_transform(range(1, len({c}) + 2), lambda i: substr('  ' || lower({c}) || ' ', i, 3)))"


@query(f"""WITH name AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, {TRIGRAMS.format(c="name")} AS a, {TRIGRAMS.format(c="'red wodget'")} AS b FROM name),
 s AS (SELECT name, len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) AS s FROM g) SELECT name, round(s, 6) AS similarity FROM s WHERE s >= 0.3 ORDER BY s DESC, name LIMIT 20""")
def fuzzy_search(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().withColumn("id", F.col("name"))
    return search.fuzzy(rows, "name", "red wodget").select("name", F.round("similarity", 6).alias("similarity"))


@query("SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def union_counts(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"))
    return a.unionByName(c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
