"""Snowball's published stemmer for Russian, applied to distinct tokens.

Regions: RV begins after the first vowel; R1 after the first consonant that follows a vowel, R2 the
same within R1.  Endings are removed within RV in four steps; ё counts as е.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "аеиоуыэюя"


def _ends(*groups: str) -> re.Pattern:
    """Longest ending first; of a group in brackets only after а or я, which stays."""
    plain = sorted((e for g in groups for e in g.split() if not e.startswith("(")), key=len, reverse=True)
    after = sorted((e.strip("()") for g in groups for e in g.split() if e.startswith("(")), key=len, reverse=True)
    parts = ([f"(?:{'|'.join(plain)})"] if plain else []) + ([f"(?<=[ая])(?:{'|'.join(after)})"] if after else [])
    return re.compile(f"(?:{'|'.join(parts)})$")


# The algorithm's endings.
GERUND = _ends("ив ивши ившись ыв ывши ывшись (в) (вши) (вшись)")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE = _ends("ивш ывш ующ (ем) (нн) (вш) (ющ) (щ)")
REFLEXIVE = _ends("ся сь")
VERB = _ends("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю (ла) (на) (ете) (йте) (ли) (й) (л) (ем) (н) (ло) (но) (ет) (ют) (ны) (ть) (ешь) (нно)")
NOUN = _ends("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
ADJECTIVAL = _ends(ADJECTIVE)
DERIVATION = _ends("ост ость")
SUPERLATIVE = _ends("ейш ейше")


def _longest(pattern: re.Pattern, rv: str) -> str | None:
    """RV without the longest ending, None if there is none."""
    found = None
    for k in range(len(rv)):
        m = pattern.match(rv, k)
        if m:
            found = rv[:k]
            break
    return found


def stem(word: str) -> str:
    word = word.replace("ё", "е")
    first = next((i for i, c in enumerate(word) if c in VOWELS), None)
    if first is None:
        return word
    head, rv = word[: first + 1], word[first + 1 :]
    region = re.search(f"[{VOWELS}][^{VOWELS}](.*)$", word)
    region = region and re.search(f"[{VOWELS}][^{VOWELS}](.*)$", region[1])
    r2 = len(word) - len(region[1]) if region else len(word)
    cut = _longest(GERUND, rv)
    if cut is None:
        shorter = _longest(REFLEXIVE, rv)
        rv = rv if shorter is None else shorter
        cut = _longest(ADJECTIVAL, rv)
        if cut is not None:
            more = _longest(PARTICIPLE, cut)
            cut = cut if more is None else more
        else:
            cut = _longest(VERB, rv)
            if cut is None:
                cut = _longest(NOUN, rv)
    rv = rv if cut is None else cut
    rv = rv[:-1] if rv.endswith("и") else rv
    cut = _longest(DERIVATION, rv)
    if cut is not None and len(head) + len(cut) >= r2:
        rv = cut
    cut = _longest(SUPERLATIVE, rv)
    rv = rv if cut is None else cut
    if rv.endswith("нн"):
        rv = rv[:-1]
    elif rv.endswith("ь"):
        rv = rv[:-1]
    return head + rv


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_table(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, stem) of the distinct tokens; Python sees each once, and only those with Cyrillic letters."""
    distinct = tokens.select(token).distinct()
    cyrillic = F.col(token).rlike("[Ѐ-ԯ]")
    return distinct.filter(cyrillic).withColumn("stem", stem_udf(token)).unionByName(distinct.filter(~cyrillic).withColumn("stem", F.col(token)))


def stem_words(text: str) -> str:
    """Words of a query, lowered and stemmed."""
    return " ".join(stem(w) for w in text.lower().split())


def stem_column(c: Column) -> Column:
    return F.when(c.rlike("[Ѐ-ԯ]"), stem_udf(c)).otherwise(c)
