"""Column functions that clean and normalise Russian street, city and place names.

All are built-in expressions, so they stay in the JVM.  White space is Unicode's; length tests that
decide a rule count UTF-8 bytes.  A null name stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W

SPACE = r"(?U)\s+"
CYRILLIC = r"[Ѐ-ԯ]"


def let(c: Column, f) -> Column:
    """f of ``c``, which is computed once: nested rules would otherwise repeat it at each mention."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def contains_cyrillic(c: Column) -> Column:
    return c.rlike(CYRILLIC)


def title_case_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def restore_case(fixed: Column, original: Column) -> Column:
    """``fixed`` with a capital if ``original`` begins with one."""
    return F.when(original.rlike(r"^\p{Lu}"), title_case_first(fixed)).otherwise(fixed)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def forms(table: dict[str, list[str]]) -> dict[str, str]:
    """Oblique form to nominative."""
    return {form: nominative for nominative, all_forms in table.items() for form in all_forms}


def _resolve(c: Column, table: dict[str, list[str]]) -> Column:
    known = literal_map(forms(table))

    def word(w: Column) -> Column:
        found = F.try_element_at(known, F.lower(w))
        return F.when(contains_cyrillic(w) & found.isNotNull(), restore_case(found, w)).otherwise(w)

    return F.array_join(F.transform(words(c), word), " ")


def normalize_oblique(c: Column) -> Column:
    """Street types in oblique cases become nominative, anywhere in the name; white space collapses."""
    return _resolve(c, W.OBLIQUE_NORMALIZER)


def normalize_street_types_case(c: Column) -> Column:
    """As :func:`normalize_oblique`, with the table of spelling repair."""
    return _resolve(c, W.OBLIQUE_CORRECTOR)


def abbreviation_forms() -> dict[str, str]:
    """Each way to write an abbreviation, without final dots, and its full form; earlier rows win."""
    found: dict[str, str] = {}
    for short, full in W.ABBREVIATIONS:
        for form in (short, *(short + s for s in W.OBLIQUE_SUFFIXES)):
            if not form.endswith("."):
                found.setdefault(form, full)
    return found


def expand_abbreviations(c: Column) -> Column:
    """The first word is written out if it is a known abbreviation; other text stays as it is, untrimmed if nothing matches."""
    known = literal_map(abbreviation_forms())

    def expand(x: Column) -> Column:
        whole, first, full = x["whole"], x["first"], x["full"]
        cased = F.when(first.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(full, 1, 1)), F.substring(full, 2, 100))).otherwise(full)
        return F.when(full.isNotNull(), F.concat(cased, F.substr(whole, F.length(first) + 1))).otherwise(x["raw"])

    def parts(x: Column) -> Column:
        full = F.try_element_at(known, F.regexp_replace(F.lower(x["first"]), r"\.+$", ""))
        return F.struct(x["raw"].alias("raw"), x["whole"].alias("whole"), x["first"].alias("first"), full.alias("full"))

    split = F.struct(c.alias("raw"), trim(c).alias("whole"), F.regexp_extract(trim(c), r"(?U)^\S+", 0).alias("first"))
    return let(let(split, parts), expand)


def normalize_rule_based(c: Column) -> Column:
    return let(expand_abbreviations(c), normalize_oblique)


def normalize_chars(c: Column) -> Column:
    """The sign U+0191 stands for one of three Cyrillic letters; known stems decide which."""
    sign = "Ƒ"
    has = lambda x, stems: F.greatest(*(x.contains(s) for s in stems))

    def pick(x: Column) -> Column:
        is_t = has(x["t"], W.BROKEN_T)
        is_k = has(x["k"], W.BROKEN_K)
        return F.when(is_t, x["t"]).when(is_k, x["k"]).otherwise(x["d"])

    tried = F.struct(*(F.replace(c, F.lit(sign), F.lit(letter)).alias(k) for k, letter in zip("tkd", "ТКД", strict=True)))
    return F.when(~c.contains(sign), c).otherwise(let(tried, pick))


def normalize_case(c: Column, types: list[str] = W.STREET_TYPES) -> Column:
    """A leading street type is lowered and the other words begin with capitals; else the first word does, and a closing street type is lowered."""
    def cased(w: Column) -> Column:
        first, last = F.lower(F.get(w, F.lit(0))), F.lower(F.try_element_at(w, F.lit(-1)))
        rest, n = F.slice(w, 2, 1_000_000), F.size(w)
        led = F.concat(F.array(first), F.transform(rest, title_case_first))
        closing = F.when((n > 1) & last.isin(types), F.concat(F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(last))).otherwise(rest)
        plain = F.concat(F.array(title_case_first(F.get(w, F.lit(0)))), closing)
        return F.when(first.isin(types), F.array_join(led, " ")).otherwise(F.array_join(plain, " "))

    return F.when(F.size(words(c)) == 0, c).otherwise(let(words(c), cased))


def noun_gender(noun: Column) -> Column:
    """f, m or n of a lower-cased word: by list, else by its ending if it is Cyrillic, else null."""
    by_end = F.when(noun.rlike("[ая]$"), "f").when(noun.rlike("[ое]$"), "n").otherwise("m")
    return F.when(noun.isin(W.FEMININE), "f").when(noun.isin(W.MASCULINE), "m").when(noun.isin(W.NEUTER), "n").when(contains_cyrillic(noun), by_end)


def fix_adjective_agreement(c: Column, exempt: list[str] | None = None) -> Column:
    """The last word but one, if it ends in -ой or -ей, takes the nominative that agrees with the last word.

    Words of ``exempt`` before a masculine noun stay.
    """
    def agree(x: Column) -> Column:
        w, n, low = x["w"], F.size(x["w"]), x["low"]
        hard = F.when(x["gender"] == "f", "ая").when(x["gender"] == "n", "ое").when(low.rlike("[кгх]ой$"), "ий").otherwise("ый")
        soft = F.when(x["gender"] == "f", "яя").when(x["gender"] == "n", "ее").otherwise("ий")
        ending = F.when(low.rlike(".ой$"), hard).when(low.rlike(".ей$"), soft)
        applies = (n >= 2) & x["gender"].isNotNull() & contains_cyrillic(low) & (F.octet_length(low) >= 4) & low.rlike(".[ое]й$")
        if exempt:
            applies &= ~((x["gender"] == "m") & low.isin(exempt))
        adjective = F.try_element_at(w, F.lit(-2))
        stem = F.substr(adjective, F.lit(1), F.greatest(F.length(adjective) - 2, F.lit(0)))
        fixed = F.concat(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(stem, ending), F.try_element_at(w, F.lit(-1))))
        return F.when(applies, F.array_join(fixed, " ")).otherwise(x["raw"])

    def parts(x: Column) -> Column:
        noun, adjective = F.lower(F.try_element_at(x["w"], F.lit(-1))), F.lower(F.try_element_at(x["w"], F.lit(-2)))
        return F.struct(x["raw"].alias("raw"), x["w"].alias("w"), adjective.alias("low"), let(noun, noun_gender).alias("gender"))

    return let(let(F.struct(c.alias("raw"), words(c).alias("w")), parts), agree)


def is_protected_word(low: Column) -> Column:
    """Words that spelling repair leaves alone: street types and endings of place names."""
    types = sorted({*W.STREET_TYPES, *W.FEMININE, *W.MASCULINE, *W.NEUTER})
    ends = lambda endings: F.greatest(*(low.endswith(e) for e in endings))
    return low.isin(types) | ends(W.PLACE_ENDINGS) | (ends(W.ADJECTIVE_ENDINGS) & (F.octet_length(low) >= 5))


def repair(c: Column) -> Column:
    """Street types' case, agreement, letter case and broken characters, in build order."""
    return let(let(let(normalize_street_types_case(c), fix_adjective_agreement), normalize_case), normalize_chars)


def normalize_name(c: Column, strict: bool = False) -> Column:
    """The whole chain: strict keeps the order of the original build, else abbreviations are expanded first."""
    if strict:
        return let(repair(c), normalize_rule_based)
    types = [*W.STREET_TYPES, "микрорайон"]
    agreed = let(normalize_rule_based(c), lambda x: fix_adjective_agreement(x, W.NOMINATIVE_OJ))
    return let(let(agreed, lambda x: normalize_case(x, types)), normalize_chars)


def dedup_key(c: Column) -> Column:
    """Trimmed, lowered, each pair of spaces made one in a single pass."""
    return F.replace(F.lower(trim(c)), F.lit("  "), F.lit(" "))


def place_label(tags: Column) -> Column:
    by_place = F.try_element_at(literal_map(W.PLACE_LABELS), tags["place"])
    return F.coalesce(by_place, F.when(tags["landuse"] == "allotments", "СНТ"))


def category_code(c: Column) -> Column:
    code = F.create_map(*(F.lit(x) for pair in W.CATEGORY_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(code, c), F.when(c.startswith("admin_level:"), 7), F.lit(0))


def region_country(region: str | None) -> str | None:
    """The first part of a region code, if it is two capital letters."""
    head = (region or "").replace("_", "-").split("-")[0]
    return head if len(head) == 2 and head.isascii() and head.isalpha() and head.isupper() else None


def size_mb(c: Column) -> Column:
    """Megabytes of ``828 MB`` or ``1.2 GB``; 0 for other text."""
    s = trim(F.replace(c, F.lit("&nbsp;"), F.lit(" ")))
    amount = F.regexp_extract(s, r"^\s*(\d+(?:\.\d*)?|\.\d+)\s*\s(?:MB|GB)$", 1)
    number = F.when(amount != "", amount.cast("double")).otherwise(0.0)
    return F.when(s.endswith(" GB"), number * 1024).otherwise(number)


def output_stem(path: Column) -> Column:
    """File name without extension, ``.osm`` and ``-latest``."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(name, r"\.osm$", ""), "-latest$", "")


def deletes(c: Column, most: int = 2) -> Column:
    """The word and what is left of it without one to ``most`` of its characters."""

    def less(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    found = level = F.array(c)
    for _ in range(most):
        level = F.flatten(F.transform(level, lambda w: F.when(F.length(w) > 0, less(w)).otherwise(F.array().cast("array<string>"))))
        level = F.array_distinct(level)
        found = F.array_union(found, level)
    return found


def fold_accents(c: Column) -> Column:
    """Latin letters without their accents; Cyrillic ones keep theirs."""
    return F.translate(c, ACCENTS, PLAIN)


ACCENTS = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def tokens(c: Column) -> Column:
    """Search tokens: runs of letters, marks and digits, lowered, Latin accents folded."""
    return F.regexp_extract_all(fold_accents(F.lower(c)), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)
