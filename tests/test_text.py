import pytest
from pyspark.sql import functions as F

from placeforge.functions import spell, stem, text
from placeforge.operators import stats
from placeforge.plans.cases import CASES


def each(spark, function, rows):
    """Outputs of a column function for (input, expected) pairs, in one job."""
    frame = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, s string")
    got = frame.select("k", function(F.col("s")).alias("o")).orderBy("k").collect()
    assert [(r[0], g.o) for r, g in zip(rows, got, strict=True)] == [tuple(r) for r in rows]


def test_contains_cyrillic(spark):
    each(spark, text.contains_cyrillic, [("Москва", True), ("улица Ленина", True), ("Moscow", False), ("123", False)])


def test_normalize_case(spark):
    each(spark, text.normalize_case, [
        ("улица Ленина", "улица Ленина"), ("УЛИЦА ПУШКИНА", "улица Пушкина"), ("проспект МИРА", "проспект Мира"), ("переулок Сивцев Вражек", "переулок Сивцев Вражек"),
        ("красная площадь", "Красная площадь"), ("МОСКВА", "Москва"), ("санкт-петербург", "Санкт-петербург"), ("", ""), (None, None),
    ])


def test_title_case(spark):
    each(spark, text.title_case_first, [("москва", "Москва"), ("МОСКВА", "Москва"), ("", ""), ("а", "А")])


def test_street_types_case(spark):
    each(spark, text.normalize_street_types_case, [
        ("Московский проспекту", "Московский проспект"), ("Ленинский проспекта", "Ленинский проспект"), ("Тверская улицы", "Тверская улица"), ("по улице", "по улица"),
        ("Сивцев переулка", "Сивцев переулок"), ("Московский проспекту съезд 1", "Московский проспект съезд 1"), ("Большое Исаково", "Большое Исаково"), ("Moscow street", "Moscow street"),
    ])


def test_expand_abbreviations(spark):
    each(spark, text.expand_abbreviations, [("Ул Ленина", "Улица Ленина"), ("Пр Мира", "Проспект Мира"), ("  ", "  "), ("пр-ту Мира", "проспект Мира"), ("ул.а Мира", "улица Мира"), (" Москва", " Москва"), ("Улей", "Улица"), (None, None)])


def test_agreement(spark):
    each(spark, text.fix_adjective_agreement, [("Тверской бульвар", "Тверский бульвар"), ("Калининградской зоопарк", "Калининградский зоопарк"), ("Синей  озеро", "Синее озеро"), ("Дальней площадь", "Дальняя площадь"), ("Main street", "Main street"), ("", "")])


def test_broken_characters(spark):
    each(spark, text.normalize_chars, [("Ƒверская", "Тверская"), ("Ƒурская", "Курская"), ("Ƒолгая", "Долгая"), ("Мира", "Мира")])


def test_evaluation_set(spark):
    cases = spark.createDataFrame(CASES, "input string, output string, category string")
    rate = lambda f: {r.category: (r.matches, r.n) for r in stats.match_report(cases.withColumn("found", f(F.col("input")))).collect()}
    rules = rate(text.normalize_rule_based)
    assert rules[None] == (48, 53) and rules["adjective"] == (0, 5)
    assert rate(text.normalize_name)[None] == (53, 53)
    strict = rate(lambda c: text.normalize_name(c, strict=True))
    assert strict[None] == (25, 53) and strict["adjective"] == (5, 5)


def test_strict_damage(spark):
    each(spark, lambda c: text.normalize_name(c, strict=True), [("ул Ленина", "Улица Ленина"), ("Тверской бульвар", "Тверский бульвар"), ("п. Озерки", "Переулок Озерки"), ("Ростов-на-Дону", "Ростов-на-дону")])
    each(spark, text.normalize_name, [("ул Ленина", "улица Ленина"), ("Тверской бульвар", "Тверской бульвар"), ("Большой проспект", "Большой проспект")])


def test_dedup_key(spark):
    each(spark, text.dedup_key, [(" А  Б ", "а б"), ("а   б", "а  б"), (" А", "а"), (None, None), ("", "")])


def test_small_functions(spark):
    each(spark, text.size_mb, [("828 MB", 828.0), ("38.4 MB", 38.4), ("1.2 GB", 1228.8), ("?", 0.0)])
    each(spark, text.output_stem, [("central-fed-district-latest.osm.pbf", "central-fed-district"), ("/data/russia-latest.osm.pbf", "russia"), ("moscow.osm.pbf", "moscow")])
    each(spark, text.category_code, [("amenity", 1), ("tourism", 2), ("admin_level:4", 7), (None, 0), ("unknown", 0)])
    assert [text.region_country(r) for r in ("RU-CFD", "RU_X", "rus", "R1-A", None, "")] == ["RU", "RU", None, None, None, None]
    each(spark, text.is_protected_word, [("проспект", True), ("исаково", True), ("диск", True), ("оренбург", True), ("дом", False), ("севастополь", True)])


def test_unicode_space(spark):
    each(spark, lambda c: F.array_join(text.words(c), "|"), [("а б  в\t", "а|б|в"), ("", "")])


def test_deletes(spark):
    rows = spark.createDataFrame([("abc",), ("a",), ("",)], "s string").select(text.deletes(F.col("s")).alias("d")).collect()
    assert set(rows[0].d) == {"abc", "ab", "ac", "bc", "a", "b", "c"} and set(rows[1].d) == {"a", ""} and rows[2].d == [""]


@pytest.mark.parametrize("a,b,d", [("москва", "москва", 0), ("москва", "мсоква", 1), ("москва", "мсква", 1), ("ab", "ba", 1), ("abcd", "badc", 2), ("abc", "xyz", 3), ("", "ab", 2)])
def test_osa(a, b, d):
    assert spell.osa(a, b) == d


CITIES = ["Гурьевск", "Балтийск", "Славск", "Гвардейск", "Светлогорск", "Зеленоградск", "Советск", "Черняховск", "Краснознаменск", "Московский проспект", "Большое Исаково"]


def test_spelling(spark):
    known = spark.createDataFrame([("москва", 9), ("маска", 9), ("улица", 5), ("проспекту", 100), ("славок", 50)], "term string, freq long")
    rows = spark.createDataFrame([(k, c) for k, c in enumerate([*CITIES, "Мосвка Улца", "дом", "Moskva", "", None])], "seq int, name string")
    got = [r.name for r in spell.correct(rows, "name", known).orderBy("seq").collect()]
    assert got == [*CITIES, "Москва Улица", "дом", "Moskva", "", None]


def test_spelling_ties(spark):
    known = spark.createDataFrame([("кот", 5), ("код", 5), ("кол", 9)], "term string, freq long")
    got = spell.suggestions(spark.createDataFrame([("ков",), ("кот",)], "word string"), known).collect()
    assert {r.word: (r.term, r.distance) for r in got} == {"ков": ("кол", 1), "кот": ("кот", 0)}


@pytest.mark.parametrize("word,want", [("москва", "москв"), ("тверская", "тверск"), ("красная", "красн"), ("площадь", "площад"), ("улицы", "улиц"), ("ленина", "ленин"), ("россия", "росс"), ("делавшийся", "дела"), ("ёлка", "елк"), ("быстрейший", "быстр"), ("гордость", "гордост"), ("мск", "мск"), ("", "")])
def test_stemmer(word, want):
    assert stem.stem(word) == want
