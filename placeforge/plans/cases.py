"""The evaluation set of name normalisation."""

# Input, right output, category.
CASES = [
    ("ул Ленина", "улица Ленина", "abbreviation"),
    ("ул. Ленина", "улица Ленина", "abbreviation"),
    ("пр Мира", "проспект Мира", "abbreviation"),
    ("пр. Мира", "проспект Мира", "abbreviation"),
    ("пр-т Мира", "проспект Мира", "abbreviation"),
    ("пер Садовый", "переулок Садовый", "abbreviation"),
    ("пер. Садовый", "переулок Садовый", "abbreviation"),
    ("бул Победы", "бульвар Победы", "abbreviation"),
    ("бульв Победы", "бульвар Победы", "abbreviation"),
    ("пл Ленина", "площадь Ленина", "abbreviation"),
    ("пл. Ленина", "площадь Ленина", "abbreviation"),
    ("наб Обводного", "набережная Обводного", "abbreviation"),
    ("наб. Обводного", "набережная Обводного", "abbreviation"),
    ("ш Энтузиастов", "шоссе Энтузиастов", "abbreviation"),
    ("ш. Энтузиастов", "шоссе Энтузиастов", "abbreviation"),
    ("пр-д Строителей", "проезд Строителей", "abbreviation"),
    ("туп Строителей", "тупик Строителей", "abbreviation"),
    ("ал Парковая", "аллея Парковая", "abbreviation"),
    ("лин 1-я", "линия 1-я", "abbreviation"),
    ("сп Крутой", "спуск Крутой", "abbreviation"),
    ("мкр Северный", "микрорайон Северный", "abbreviation"),
    ("мкр. Северный", "микрорайон Северный", "abbreviation"),
    ("п Строителей", "переулок Строителей", "abbreviation"),
    ("п. Строителей", "переулок Строителей", "abbreviation"),
    ("улицы Ленина", "улица Ленина", "oblique"),
    ("улице Ленина", "улица Ленина", "oblique"),
    ("улицу Ленина", "улица Ленина", "oblique"),
    ("проспекту Мира", "проспект Мира", "oblique"),
    ("проспекта Мира", "проспект Мира", "oblique"),
    ("проспектом Мира", "проспект Мира", "oblique"),
    ("переулка Садового", "переулок Садового", "oblique"),
    ("площади Ленина", "площадь Ленина", "oblique"),
    ("набережной Обводного", "набережная Обводного", "oblique"),
    ("бульвара Победы", "бульвар Победы", "oblique"),
    ("Ленинский проспекта", "Ленинский проспект", "oblique"),
    ("Тверская улицы", "Тверская улица", "oblique"),
    ("пр-ту Мира", "проспект Мира", "combined"),
    ("пр-та Мира", "проспект Мира", "combined"),
    ("Калининградской улица", "Калининградская улица", "adjective"),
    ("Калининградской зоопарк", "Калининградский зоопарк", "adjective"),
    ("Московской проспект", "Московский проспект", "adjective"),
    ("Тверской улица", "Тверская улица", "adjective"),
    ("Ленинградской набережная", "Ленинградская набережная", "adjective"),
    ("улица Ленина", "улица Ленина", "noop"),
    ("проспект Мира", "проспект Мира", "noop"),
    ("бульвар Победы", "бульвар Победы", "noop"),
    ("площадь Ленина", "площадь Ленина", "noop"),
    ("набережная Обводного", "набережная Обводного", "noop"),
    ("шоссе Энтузиастов", "шоссе Энтузиастов", "noop"),
    ("Москва", "Москва", "noop"),
    ("Калининград", "Калининград", "noop"),
    ("Большое Исаково", "Большое Исаково", "noop"),
    ("Красная площадь", "Красная площадь", "noop"),
]
