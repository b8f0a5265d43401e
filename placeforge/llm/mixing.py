"""Mixing of sources to target weights by Poisson replication, with DataFrame functions only.

A source of size s (characters) with target share w of a budget of T characters repeats its
documents at the mean rate r = w * T / s.  A document's count inverts the Poisson distribution of
mean r at a uniform number from a hash of seed, id and text: it depends on nothing else, so a rerun or a
lost executor gives the same mixture.  Rates above CHUNK are summed from independent Poisson counts
of smaller mean, so that exp(-r) stays a normal number.  The distribution function is a list made once
for each source.  Each document is exploded by its count, and all copies are shuffled: dealt by a hash
of (seed, document, copy) and sorted by it in each shard.

Null text has no size and repeats at its source's rate.  A null source is a source of its own.  Rows
equal in id and text get equal counts and order, but for a null id: there the row's place in the input
counts too, so that many such rows are independent and spread out.  A source that ``weights`` doesn't
name has weight 0 and goes; an empty table stays empty.  Ties in the order's key keep any order.
Columns of any name pass through :func:`remix`; :func:`mix` replaces those that have its own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

CHUNK = 200.0
SEED = 17
#: Sources up to which their rates are broadcast; more are joined by shuffling, where AQE splits a hot source.
MOST_BROADCAST = 5_000
#: Exponent on a source's size for the default weights: between equal shares (0) and as they are (1).
TEMPER = 0.5


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 hash."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def distribution(mean: Column) -> Column:
    """The distribution function of a Poisson count of ``mean`` (CHUNK at most) at 0, 1, ... as a list that ends where 1 is reached."""
    # 12 standard deviations and 30 more: what is left beyond is under 1e-16
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        return F.struct(p.alias("p"), F.array_append(a["c"], F.element_at(a["c"], -1) + p).alias("c"))

    return F.aggregate(steps, first, step, lambda a: F.filter(a["c"], lambda c, k: (k == 0) | (F.get(a["c"], k - 1) < 1 - 2.0**-53)))


def poisson(u: Column, law: Column) -> Column:
    """The smallest k at which the distribution function ``law`` reaches u."""
    return F.size(F.filter(law, lambda c: c < u))


def repeats(chunks: Column, law: Column, seed: int, key: list[Column]) -> Column:
    """A count from hashes of seed, key and chunk number; ``law`` is that of one chunk."""
    counts = F.transform(F.sequence(F.lit(1), chunks), lambda i: poisson(uniform(F.lit(seed), *key, i), law))
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, temper: float = TEMPER) -> DataFrame:
    """(source, rate): mean repetitions of the documents of each source.

    Without ``weights`` a source's share is its size to the power ``temper``; without ``budget`` the
    mixture is as large as the input.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("w", F.when(F.col("size") > 0, F.pow("size", F.lit(temper))).otherwise(0.0))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "name string, w double")
        sizes = sizes.join(named, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    whole = Window.partitionBy(F.lit(0))  # over sources, not documents
    share = sizes.withColumn("all_size", F.sum("size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    amount = F.col("all_size") if budget is None else F.lit(float(budget))
    rate = F.when((F.col("size") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * amount / F.col("size")).otherwise(0.0)
    return share.select("source", rate.alias("rate"))


def _copies(docs: DataFrame, weights: dict[str | None, float] | None, budget: float | None, seed: int, temper: float) -> DataFrame:
    """(row, rate, count, copy, order) of the mixture in its order; ``row`` has the columns of ``docs``, whatever their names."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int"))
    known = rates(docs, weights, budget, temper).withColumn("chunks", chunks)
    known = materialize(known.select(F.col("source").alias("of"), "rate", "chunks", distribution(F.col("rate") / F.col("chunks")).alias("law")))
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    own = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), F.concat_ws("/", F.col("doc_id").cast("string"), place.cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("name"))
    drawn = own.join(known, F.col("source").eqNullSafe(F.col("of"))).withColumn("count", repeats(F.col("chunks"), F.col("law"), seed, [F.col("name")]))
    drawn = drawn.select("row", "rate", "name", "count").filter(F.col("count") > 0)
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), "name", F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("order", order).drop("name").repartition("order").sortWithinPartitions("order")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, seed: int = SEED, temper: float = TEMPER) -> DataFrame:
    """The mixture: the columns of ``docs``, then mix_rate, mix_count, mix_copy (1 to the count) and mix_order (the shuffle's key).

    Columns of ``docs`` that have one of these names are replaced.
    """
    names = ["rate", "count", "copy", "order"]
    made = _copies(docs.drop(*(f"mix_{n}" for n in names)), weights, budget, seed, temper)
    return made.select("row.*", *(F.col(n).alias(f"mix_{n}") for n in names))


def remix(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, seed: int = SEED, temper: float = TEMPER) -> DataFrame:
    """The mixture with the columns of ``docs`` alone, all as they are."""
    return _copies(docs, weights, budget, seed, temper).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "lang", "source", "n_chars", F.round("mix_rate", 9).alias("mix_rate"), "mix_count", "mix_copy", "mix_order")


SQL = f"""
WITH size AS (SELECT source, sum(coalesce(length(text), 0)::DOUBLE) AS size FROM documents GROUP BY source),
share AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {TEMPER}) ELSE 0 END AS w FROM size),
rate AS (SELECT source, CASE WHEN size > 0 THEN w / (SELECT sum(w) FROM share) * (SELECT sum(size) FROM share) / size ELSE 0 END AS rate FROM share),
law AS (SELECT source, rate, k, sum(exp(-rate + k * ln(greatest(rate, 1e-300)) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM rate, generate_series(0, 700) AS g(k)),
drawn AS (SELECT d.*, r.rate, (('0x' || substr(md5('{SEED}:' || d.doc_id || '/' || md5(coalesce(d.text, '')) || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
          FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, (SELECT count(*) FROM law l WHERE l.source IS NOT DISTINCT FROM d.source AND l.c < d.u) AS n FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS mix_rate, n::INTEGER AS mix_count, copy::INTEGER AS mix_copy,
       md5('{SEED}:order:' || doc_id || '/' || md5(coalesce(text, '')) || ':' || copy) AS mix_order
FROM counted, unnest(range(1, n + 1)) AS c(copy) WHERE n > 0
"""
