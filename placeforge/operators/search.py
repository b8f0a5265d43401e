"""Full-text search: inverted index, prefix queries joined by AND, BM25 ranking, boxes and nearest points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, stem, text

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LIMIT = 20


def postings(rows: DataFrame, columns: list[str], id_column: str = "id", stemmed: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, col, term, tf) over ``columns``; the tokens of ``stemmed`` ones are stemmed, each distinct token once."""
    parts = [rows.select(F.col(id_column).alias("doc_id"), F.lit(c).alias("col"), F.explode(text.tokens(F.coalesce(F.col(c), F.lit("")))).alias("term")) for c in columns]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    counted = every.groupBy("doc_id", "col", "term").agg(F.count("*").alias("tf"))
    if not stemmed:
        return counted
    # a few stem to the same term
    stems = stem.stem_table(counted.filter(F.col("col").isin(*stemmed)), "term").withColumnRenamed("term", "raw")
    joined = counted.join(stems, (F.col("term") == F.col("raw")) & F.col("col").isin(*stemmed), "left")
    return joined.select("doc_id", "col", F.coalesce("stem", "term").alias("term"), "tf").groupBy("doc_id", "col", "term").agg(F.sum("tf").alias("tf"))


#: Lengths of the prefixes that stored postings carry.
PREFIXES = (2, 3, 4)


def with_prefixes(posted: DataFrame) -> DataFrame:
    """Postings with the first 2, 3 and 4 characters of the term (p2, p3, p4; null for shorter terms)."""
    return posted.withColumns({f"p{n}": F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in PREFIXES})


def starts(posted: DataFrame, prefix: str) -> Column:
    """Whether the term starts with ``prefix``, narrowed by an equality on the longest prefix column that there is."""
    fitting = [n for n in PREFIXES if n <= len(prefix) and f"p{n}" in posted.columns]
    hit = F.col("term").startswith(prefix)
    return (F.col(f"p{fitting[-1]}") == prefix[: fitting[-1]]) & hit if fitting else hit


def lengths(posted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens)."""
    return posted.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"))


def scanned(rows: DataFrame, columns: list[str], terms: list[str], id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Postings of the terms that begin with one of ``terms``, and lengths, straight from the rows: other terms aren't shuffled.

    For tables without stored postings.
    """
    own = F.concat(*(F.transform(text.tokens(F.coalesce(F.col(c), F.lit(""))), lambda t, c=c: F.struct(F.lit(c).alias("col"), t.alias("term"))) for c in columns))
    hit = lambda t: F.greatest(*(t["term"].startswith(p) for p in terms), F.lit(False))
    found = rows.select(F.col(id_column).alias("doc_id"), F.inline(F.filter(own, hit)))
    size = F.size(F.concat(*(text.tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns)))
    sizes = rows.select(F.col(id_column).alias("doc_id"), size.cast("long").alias("n_tokens")).filter("n_tokens > 0")
    return found.groupBy("doc_id", "col", "term").agg(F.count("*").alias("tf")), sizes


def prefixes(query: str, stemmed: bool = True, strict: bool = False) -> list[str]:
    """The prefix of each query term.  ``strict`` gives none for a query with punctuation, which a full-text grammar would refuse."""
    if strict and re.search(r"[^\w\s]", query):
        return []
    found = re.findall(r"[^\W_]+", query.lower().translate(str.maketrans(text.ACCENTS, text.PLAIN)))
    return [stem.stem(t) for t in found] if stemmed else found


def hits(posted: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term_no, f): how often each term's prefix occurs in each document, in any column."""
    asked = F.array(*(F.struct(F.lit(k).alias("term_no"), F.lit(t).alias("prefix")) for k, t in enumerate(terms)))
    found = F.filter(asked, lambda a: F.col("term").startswith(a["prefix"]))
    any_ = F.lit(False)
    for t in terms:
        any_ |= starts(posted, t)
    rows = posted.filter(any_).select("doc_id", "tf", F.explode(found).alias("a"))
    return rows.groupBy("doc_id", "a.term_no").agg(F.sum("tf").alias("f"))


def match_all(posted: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id) with every term."""
    if not terms:
        return posted.select("doc_id").limit(0)
    return hits(posted, terms).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(terms)).select("doc_id")


def bm25(posted: DataFrame, sizes: DataFrame, terms: list[str], n_docs: Column | None = None) -> DataFrame:
    """(doc_id, rank) of documents with every term; lower ranks are better."""
    if not terms:
        return sizes.select("doc_id", F.lit(0.0).alias("rank")).limit(0)
    found = hits(posted, terms)
    spread = found.groupBy("term_no").agg(F.count("*").cast("double").alias("n"))
    corpus = sizes.agg(F.count("*").cast("double").alias("docs"), F.avg("n_tokens").alias("mean"))
    # one row for each query term, and one of corpus totals
    facts = F.broadcast(spread.join(F.broadcast(corpus), F.lit(True)))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = found.join(facts, "term_no").join(sizes, "doc_id")
    f = F.col("f")
    part = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    scored = weighed.groupBy("doc_id").agg((-F.sum(part)).alias("rank"), F.count("*").alias("k"))
    return scored.filter(F.col("k") == len(terms)).select("doc_id", "rank")


def top(scored: DataFrame, limit: int = LIMIT) -> DataFrame:
    return scored.orderBy("rank", "doc_id").limit(limit)


def search(objects: DataFrame, posted: DataFrame, sizes: DataFrame, query: str, limit: int = LIMIT, category: str | None = None, box: tuple[float, float, float, float] | None = None, strict: bool = False, stemmed: bool = True) -> DataFrame:
    """The best objects with their rank; category and box are tested on the objects."""
    scored = bm25(posted, sizes, prefixes(query, stemmed, strict))
    kept = objects
    if category is not None:
        kept = kept.filter(F.col("category") == category)
    if box is not None:
        kept = kept.filter(geo.in_box(F.col("lat"), F.col("lon"), *box))
    if category is not None or box is not None:
        scored = scored.join(kept.select(F.col("id").alias("kept")), F.col("doc_id") == F.col("kept"), "left_semi")
    best = F.broadcast(top(scored, limit))  # ``limit`` rows
    return kept.join(best, F.col("id") == F.col("doc_id")).drop("doc_id").orderBy("rank", "id")


def nearest_points(objects: DataFrame, lat: float, lon: float, limit: int = LIMIT, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The nearest by squared degrees, of those in the box."""
    rows = objects if box is None else objects.filter(geo.in_box(F.col("lat"), F.col("lon"), *box))
    return rows.withColumn("d2", geo.planar2(F.col("lat"), F.col("lon"), lat, lon)).orderBy("d2", "id").limit(limit)


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def fuzzy(objects: DataFrame, column: str, query: str, least: float = 0.3, limit: int = LIMIT) -> DataFrame:
    """Rows by trigram Jaccard similarity of ``column`` to the query."""
    own, asked = trigrams(F.col(column)), trigrams(F.lit(query))
    rows = objects.filter(F.col(column).isNotNull()).withColumn("similarity", F.size(F.array_intersect(own, asked)) / F.size(F.array_union(own, asked)))
    return rows.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(limit)


def address_line(objects: DataFrame) -> Column:
    """How a hit is printed: the parts of an address, or a name with its category."""
    poi = F.concat(F.coalesce("name", F.lit("?")), F.lit(" ("), F.coalesce("category", F.lit("без категории")), F.lit(")"))
    return F.when(objects["type"] == 0, F.concat_ws(", ", "country", "city", "street", "housenumber")).otherwise(poi)
