"""Word tables that results depend on."""

# Street-type abbreviations and their full forms, in order of precedence.
ABBREVIATIONS = [
    ("ул", "улица"), ("ул.", "улица"),
    ("пр", "проспект"), ("пр.", "проспект"), ("пр-т", "проспект"),
    ("пер", "переулок"), ("пер.", "переулок"), ("п", "переулок"), ("п.", "переулок"),
    ("бул", "бульвар"), ("бульв", "бульвар"),
    ("пл", "площадь"), ("пл.", "площадь"),
    ("наб", "набережная"), ("наб.", "набережная"),
    ("ш", "шоссе"), ("ш.", "шоссе"),
    ("пр-д", "проезд"),
    ("туп", "тупик"),
    ("ал", "аллея"),
    ("лин", "линия"),
    ("сп", "спуск"),
    ("мкр", "микрорайон"), ("мкр.", "микрорайон"),
]

# Case endings that an abbreviation may carry.
OBLIQUE_SUFFIXES = ["а", "у", "ом", "е", "ой", "ей", "ы", "и"]

# Oblique forms of street types that normalisation resolves.
OBLIQUE_NORMALIZER = {
    "улица": ["улицы", "улице", "улицу", "улицей"],
    "проспект": ["проспекта", "проспекту", "проспектом"],
    "переулок": ["переулка", "переулку", "переулком"],
    "бульвар": ["бульвара", "бульвару", "бульваром"],
    "площадь": ["площади", "площадью"],
    "набережная": ["набережной"],
    "проезд": ["проезда", "проезду", "проездом"],
    "тупик": ["тупика", "тупику", "тупиком"],
    "аллея": ["аллеи", "аллее", "аллею", "аллеей"],
    "линия": ["линии", "линией"],
    "спуск": ["спуска", "спуску", "спуском"],
    "микрорайон": ["микрорайона", "микрорайону", "микрорайоном"],
}

# Oblique forms of street types that spelling repair resolves.
OBLIQUE_CORRECTOR = {
    "проспект": ["проспекта", "проспекту"],
    "бульвар": ["бульвара", "бульвару"],
    "проезд": ["проезда", "проезду"],
    "тупик": ["тупика", "тупику"],
    "вал": ["вала", "валу"],
    "спуск": ["спуска", "спуску"],
    "подъезд": ["подъезда", "подъезду"],
    "тракт": ["тракта", "тракту"],
    "мост": ["моста", "мосту"],
    "канал": ["канала", "каналу"],
    "съезд": ["съезда", "съезду"],
    "переулок": ["переулка", "переулку"],
    "улица": ["улицы", "улице"],
    "аллея": ["аллеи"],
    "линия": ["линии"],
    "дорога": ["дороги", "дороге"],
    "набережная": ["набережной"],
    "площадь": ["площади"],
}

# Oblique forms that training pairs are made from.
OBLIQUE_PAIRS = {
    "улица": ["улицы", "улице", "улицу", "улицей"],
    "проспект": ["проспекта", "проспекту", "проспектом"],
    "переулок": ["переулка", "переулку", "переулком"],
    "бульвар": ["бульвара", "бульвару", "бульваром"],
    "площадь": ["площади", "площадью"],
    "набережная": ["набережной"],
    "проезд": ["проезда", "проезду", "проездом"],
    "тупик": ["тупика", "тупику", "тупиком"],
    "аллея": ["аллеи", "аллее", "аллею", "аллеей"],
    "линия": ["линии", "линией"],
    "спуск": ["спуска", "спуску", "спуском"],
    "дорога": ["дороги", "дороге", "дорогу", "дорогой"],
    "тракт": ["тракта", "тракту", "трактом"],
    "мост": ["моста", "мосту", "мостом"],
    "микрорайон": ["микрорайона", "микрорайону", "микрорайоном"],
}

# Adjectives of training pairs, oblique and nominative, and the nouns they go with, by gender.
ADJECTIVE_PAIRS = {
    "f": [
        ("Московской", "Московская"), ("Тверской", "Тверская"), ("Ленинградской", "Ленинградская"), ("Калининградской", "Калининградская"), ("Казанской", "Казанская"),
        ("Сибирской", "Сибирская"), ("Российской", "Российская"), ("Большой", "Большая"), ("Красной", "Красная"), ("Весенней", "Весенняя"),
        ("Зимней", "Зимняя"), ("Летней", "Летняя"), ("Осенней", "Осенняя"), ("Соседней", "Соседняя"), ("Дальней", "Дальняя"),
    ],
    "m": [
        ("Ленинской", "Ленинский"), ("Московской", "Московский"), ("Кутузовской", "Кутузовский"), ("Советской", "Советский"), ("Большой", "Большой"),
        ("Красной", "Красный"), ("Малой", "Малый"), ("Синей", "Синий"), ("Последней", "Последний"),
    ],
    "n": [("Большой", "Большое"), ("Красной", "Красное"), ("Синей", "Синее")],
}
PAIR_NOUNS = {
    "f": ["улица", "площадь", "набережная", "аллея", "дорога", "линия"],
    "m": ["проспект", "переулок", "бульвар", "проезд", "тупик", "мост"],
    "n": ["шоссе", "озеро", "поле"],
}
AGREED_PAIRS = [
    ("Калининградской улица", "Калининградская улица"), ("Калининградской зоопарк", "Калининградский зоопарк"), ("Калининградской шоссе", "Калининградское шоссе"),
    ("Московской проспект", "Московский проспект"), ("Московской площадь", "Московская площадь"), ("Тверской улица", "Тверская улица"), ("Тверской бульвар", "Тверской бульвар"),
    ("Ленинградской набережная", "Ленинградская набережная"), ("Невской проспект", "Невский проспект"), ("Арбатской переулок", "Арбатский переулок"), ("Садовой кольцо", "Садовое кольцо"),
    ("Красной ворота", "Красные ворота"), ("Петровской парк", "Петровский парк"), ("Смоленской метро", "Смоленская метро"),
]

# Street types and places of training pairs that stay as they are.
PAIR_TYPES = [
    "улица", "проспект", "переулок", "бульвар", "проезд", "площадь", "набережная", "шоссе", "аллея", "тупик",
    "линия", "вал", "спуск", "дорога", "тракт", "мост", "канал", "съезд", "микрорайон",
]
PAIR_PLACES = [
    "Москва", "Санкт-Петербург", "Новосибирск", "Екатеринбург", "Казань", "Калининград", "Владивосток", "Сочи", "Нижний Новгород",
    "Ростов-на-Дону", "Красноярск", "Иркутск", "Большое Исаково", "Малое Исаково", "Старое Крюково", "Красная Поляна", "Зелёный Бор", "Солнечный Город",
]

# Words that count as a street type at either end of a name.
STREET_TYPES = ["улица", "проспект", "переулок", "бульвар", "проезд", "площадь", "набережная", "шоссе", "аллея", "тупик", "линия", "вал", "спуск", "подъезд", "дорога", "тракт", "мост", "канал", "съезд"]

# Street types by grammatical gender.
FEMININE = ["улица", "набережная", "площадь", "аллея", "линия", "дорога"]
MASCULINE = ["проспект", "переулок", "бульвар", "проезд", "тупик", "вал", "спуск", "подъезд", "тракт", "мост", "канал", "съезд"]
NEUTER = ["шоссе"]

#: Masculine nominatives in -ой, which look like feminine genitives; kept before masculine nouns unless strict.
NOMINATIVE_OJ = ["тверской", "большой", "морской", "городской", "донской", "луговой", "полевой", "береговой", "садовой", "степной", "лесной", "речной", "мостовой", "заводской"]

# Labels of place kinds.
PLACE_LABELS = {
    "allotments": "СНТ",
    "hamlet": "посёлок",
    "village": "деревня",
    "isolated_dwelling": "хутор",
    "locality": "урочище",
    "suburb": "микрорайон",
    "neighbourhood": "квартал",
    "town": "город",
    "city": "город",
    "borough": "район",
}

# Category codes of the compact format; every ``admin_level:`` category counts as boundary.
CATEGORY_CODES = {"amenity": 1, "tourism": 2, "shop": 3, "historic": 4, "leisure": 5, "office": 6, "boundary": 7, "highway": 8, "railway": 9, "aeroway": 10, "waterway": 11, "natural": 12}

# Beginnings of names in which a broken first letter was one of two letters.
BROKEN_T = ["Тверс", "Тульс", "Томс"]
BROKEN_K = ["Камск", "Курск", "Казан", "Киевс", "Коломен", "Красно"]

# Endings of place names, and of adjectives made from them.
PLACE_ENDINGS = ["ово", "ево", "ино", "град", "бург", "поль"]
ADJECTIVE_ENDINGS = ["ск", "цк"]
