"""Synthetic pairs of a badly written street name and the right one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as W


def _frame(spark, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "form string, full string")


def _with_names(names: DataFrame, forms: DataFrame) -> DataFrame:
    """Every name with every form: the product that is asked for; forms are a fixed list."""
    return names.select("name").crossJoin(F.broadcast(forms))


def abbreviation_pairs(names: DataFrame) -> DataFrame:
    rows = _with_names(names, _frame(names.sparkSession, W.ABBREVIATIONS))
    f, n = F.col("form"), F.col("name")
    inputs = F.array(F.concat(f, F.lit(" "), n), F.concat(f, F.lit(". "), n), F.concat(f, F.lit("."), n))
    return rows.select(F.explode(inputs).alias("input"), F.concat_ws(" ", "full", "name").alias("output"))


def oblique_pairs(names: DataFrame) -> DataFrame:
    rows = _with_names(names, _frame(names.sparkSession, [(o, full) for full, forms in W.OBLIQUE_PAIRS.items() for o in forms]))
    both = F.array(F.struct(F.concat_ws(" ", "form", "name").alias("input"), F.concat_ws(" ", "full", "name").alias("output")), F.struct(F.concat_ws(" ", "name", "form").alias("input"), F.concat_ws(" ", "name", "full").alias("output")))
    return rows.select(F.inline(both))


def suffixed_pairs(names: DataFrame) -> DataFrame:
    made = []
    for short, full in W.ABBREVIATIONS:
        for s in W.OBLIQUE_SUFFIXES:
            made.append((short.rstrip(".") + s, full))
            if "." in short:
                made.append((short.rstrip(".") + s + ".", full))
    return _with_names(names, _frame(names.sparkSession, made)).select(F.concat_ws(" ", "form", "name").alias("input"), F.concat_ws(" ", "full", "name").alias("output"))


def adjective_pairs(adjectives: DataFrame, nouns: DataFrame) -> DataFrame:
    """(oblique, nominative, gender) with (noun, gender)."""
    return adjectives.join(F.broadcast(nouns), "gender").select(F.concat_ws(" ", "oblique", "noun").alias("input"), F.concat_ws(" ", "nominative", "noun").alias("output"))


def unchanged_pairs(names: DataFrame, types: list[str], others: list[str] = ()) -> DataFrame:
    spark = names.sparkSession
    made = _with_names(names, _frame(spark, [(t, t) for t in types])).select(F.concat_ws(" ", "form", "name").alias("input"))
    if others:
        made = made.unionByName(spark.createDataFrame([(o,) for o in others], "input string"))
    return made.select("input", F.col("input").alias("output"))


def every_pair(names: DataFrame) -> DataFrame:
    """(kind, input, output) of the five sorts of pairs, made from ``names`` (name) and the fixed word tables."""
    spark = names.sparkSession
    adjectives = spark.createDataFrame([(o, n, g) for g, rows in W.ADJECTIVE_PAIRS.items() for o, n in rows], "oblique string, nominative string, gender string")
    nouns = spark.createDataFrame([(n, g) for g, rows in W.PAIR_NOUNS.items() for n in rows], "noun string, gender string")
    agreed = adjective_pairs(adjectives, nouns).unionByName(spark.createDataFrame(W.AGREED_PAIRS, "input string, output string"))
    made = {"abbreviation": abbreviation_pairs(names), "oblique": oblique_pairs(names), "abbreviated_oblique": suffixed_pairs(names), "adjective_agreement": agreed, "noop": unchanged_pairs(names, W.PAIR_TYPES, W.PAIR_PLACES)}
    return reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), "input", "output") for kind, rows in made.items()))


def dataset(pairs: DataFrame, seed: int = 42, train: float = 0.9) -> DataFrame:
    """Pairs (kind, input, output) once each, with their split and shuffling key."""
    return shuffle_split(pairs.select("input", "output").distinct(), seed, train)


def dataset_stats(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, n): pairs in all and of each split, without repeats, and of each kind, with them."""
    split = parts.groupBy("split").agg(F.count("*").alias("n")).select(F.concat("split", F.lit("_pairs")).alias("key"), "n")
    kinds = pairs.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat("kind", F.lit("_pairs")).alias("key"), "n")
    return parts.agg(F.lit("total_pairs").alias("key"), F.count("*").alias("n")).unionByName(split).unionByName(kinds)


def write_dataset(names: DataFrame, path: str, seed: int = 42, train: float = 0.9) -> dict[str, int]:
    """Shuffled train and val pairs as JSON lines and as tab-separated text, and their counts as ``stats.json``; returns the counts."""
    from ..plans.build import save

    pairs = every_pair(names)
    parts = save(dataset(pairs, seed, train))
    for split in ("train", "val"):
        own = parts.filter(F.col("split") == split).orderBy("shuffle_key", "input", "output")
        write_pairs(own, f"{path}/{split}.jsonl")
        write_pairs(own, f"{path}/{split}.tsv", "tsv")
    found = {"total_pairs": 0, "train_pairs": 0, "val_pairs": 0} | {r.key: r.n for r in dataset_stats(pairs, parts).collect()}
    facts = names.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/stats.json")
    return found


def distinct_first(pairs: DataFrame, order: Column) -> DataFrame:
    """The first of equal pairs by ``order``."""
    return pairs.groupBy("input", "output").agg(F.min(order).alias("first"))


def shuffle_split(pairs: DataFrame, seed: int = 42, train: float = 0.9) -> DataFrame:
    """Pairs with a shuffling key and a split, both from a hash of seed and pair: the same wherever it runs."""
    key = F.xxhash64(F.lit(seed), "input", "output")
    return pairs.withColumn("shuffle_key", key).withColumn("split", F.when(F.pmod(key, F.lit(10_000)) < int(10_000 * train), "train").otherwise("val"))


def subsample(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return pairs.orderBy(F.xxhash64(F.lit(seed), "input", "output"), "input", "output").limit(n)


def write_pairs(pairs: DataFrame, path: str, kind: str = "json") -> None:
    writer = pairs.select("input", "output").write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("sep", "\t").option("header", True).csv(path)
