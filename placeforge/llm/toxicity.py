"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: lower case; Greek and Cyrillic look-alikes become Latin letters; digits and signs that
stand for letters do so beside letters.  Lexicon entries are stems, matched at the start of a word.
They are learned from labelled texts: of all word beginnings, those whose log-likelihood ratio for
label 1 is beyond LEAST_G2 at a precision of LEAST_PRECISION, the longest of equal support, without
those that have an entry as their beginning.  What near copies of one text share stands behind the
same word each time, so an entry needs an effective number (inverse Simpson index) of LEAST_CONTEXTS
words before it.  The weight is the log odds.  A two-word phrase around
an entry that only clean texts have is an exception and covers the hit.  The score is a logistic
function of the summed weights, alone and per hundred words.

The classifier is fitted on about ``most`` labelled rows at most (a bounded sample by a hash of the
id), which bounds all that is learned.  Of repeated labels the larger counts; of documents that share
a labelled id the one whose text has the smallest hash; equal texts count once; null ids have no label.
Null and empty texts have no hit and get the score of no hit.  Without labels of both kinds the lexicon
is empty and every score is 0; a score of one half is label 1.  Equal texts get equal scores; rows with
null or repeated ids are rows like others, other columns pass through, an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, table

#: Labelled rows that the classifier is fitted on, about.
MOST_ROWS = 20_000
LEAST_G2, LEAST_PRECISION, STEM = 20.0, 0.95, (3, 12)
LEAST_CONTEXTS = 2.0

LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһԛԝвмнткαεικνορτυχ", "aeopcyxijsdhqwbmhtkaeiknoptux")
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
FOREIGN = re.compile("[Ͱ-ӿԀ-ԯ]")
SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|(?<!\S)[0134578@$](?=[^\W\d_])")
HIDDEN = re.compile("[­​-‏⁠﻿]")
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case without look-alikes, letter signs and invisible characters."""
    text = text.lower()
    if not text.isascii():
        text = HIDDEN.sub("", text)
        if FOREIGN.search(text):
            text = text.translate(LOOK_ALIKES)
    return SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)


@dataclass
class Lexicon:
    """Stems with weights, exception phrases, and the logistic function's three numbers (none: score 0)."""

    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        made = ahocorasick.Automaton()
        for stem, w in self.stems.items():
            made.add_word(stem, (len(stem), w))
        if self.stems:
            made.make_automaton()
        return made


def hits(folded: str, automaton) -> Iterator[tuple[int, int, int, float]]:
    """(start, end of entry, end of word, weight) of entries at the starts of words."""
    if not len(automaton):
        return
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if start and folded[start - 1].isalpha():
            continue
        stop = end + 1
        while stop < len(folded) and folded[stop].isalpha():
            stop += 1
        yield start, end + 1, stop, w


def phrases(folded: str, start: int, stop: int) -> list[str]:
    """The hit with the word before it, and with the word after it."""
    before = WORD.findall(folded, max(0, start - 40), start)
    after = WORD.search(folded, stop, stop + 40)
    return ([f"{before[-1]} {folded[start:stop]}"] if before else []) + ([f"{folded[start:stop]} {after[0]}"] if after else [])


def weigh(text: str | None, automaton, exceptions: frozenset[str]) -> tuple[float, int]:
    """Sum of the weights of the hits outside exception phrases; words."""
    if not text:
        return 0.0, 0
    folded, total = fold(text), 0.0
    for start, _, stop, w in hits(folded, automaton):
        if not exceptions or exceptions.isdisjoint(phrases(folded, start, stop)):
            total += w
    return total, len(text.split())


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], 1)


def score(x: np.ndarray, curve: tuple[float, float, float] | None) -> np.ndarray:
    if curve is None:
        return np.zeros(len(x))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(curve), -30, 30)))


def _count_stems(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, high = STEM
    for batch in slices(batches, "text"):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: set[str] = set()
            for w in set(WORD.findall(fold(text))):
                found.update(w[:k] for k in range(low, min(len(w), high) + 1))
            counts[label].update(found)
        stems = list(counts[1])
        other = [s for s in counts[0] if s not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(stems + other, pa.string()), pa.array([counts[1][s] for s in stems] + [0] * len(other), pa.int64()), pa.array([counts[0][s] for s in stems] + [counts[0][s] for s in other], pa.int64())], ["stem", "pos", "neg"])


def _count_phrases(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "text"):
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                for p in {p for start, _, stop, _ in hits(folded, automaton) for p in phrases(folded, start, stop)}:
                    counts.setdefault(p, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (1, 0))], ["phrase", "pos", "neg"])

    return run


def _count_contexts(lexicon: Lexicon):
    """How many texts of label 1 have an entry behind a word (empty at the beginning of a text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "text"):
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                counts.update({(folded[a:b], (WORD.findall(folded, max(0, a - 40), a) or [""])[-1]) for a, b, _, _ in hits(folded, automaton)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["stem", "context", "n"])

    return run


def _weigh_all(lexicon: Lexicon, columns: list[str]):
    """The columns after the text, then its weight and words, and the score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "text"):
            both = [weigh(t, automaton, lexicon.exceptions) for t in batch.column(0).to_pylist()]
            total, words = np.array([b[0] for b in both]), np.array([b[1] for b in both], np.float64)
            made = [pa.array(total), pa.array(words), pa.array(score(features(total, words), lexicon.curve))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*columns, "weight", "words", "score"])

    return run


def g2(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Log-likelihood ratio of a stem's texts having another rate of label 1 than all texts; 0 if lower."""
    n, rate = pos + neg, all_pos / (all_pos + all_neg)
    if pos <= rate * n:
        return 0.0
    return 2 * (pos * log(pos / (rate * n)) + (neg * log(neg / ((1 - rate) * n)) if neg else 0.0))


def choose(counts: dict[str, tuple[int, int]], all_pos: int, all_neg: int) -> dict[str, float]:
    """Stems with weights."""
    extended: dict[str, int] = {}
    for stem, (pos, _) in counts.items():
        extended[stem[:-1]] = max(extended.get(stem[:-1], 0), pos)
    kept: dict[str, float] = {}
    for stem in sorted(counts, key=lambda s: (len(s), s)):
        pos, neg = counts[stem]
        if g2(pos, neg, all_pos, all_neg) < LEAST_G2 or pos < LEAST_PRECISION * (pos + neg) or extended.get(stem, 0) >= LEAST_PRECISION * pos:
            continue
        if not any(stem[:k] in kept for k in range(STEM[0], len(stem))):
            kept[stem] = log((pos + 0.5) / (all_pos + 1)) - log((neg + 0.5) / (all_neg + 1))
    return kept


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Lexicon:
    """Fit on documents whose id has a label in ``labels`` (doc_id, toxic); only ids outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod("doc_id", 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # at most about ``most`` rows of two numbers: safe to broadcast
    joined = docs.select(F.col("doc_id").cast("long"), "text").filter("text IS NOT NULL").join(F.broadcast(known), "doc_id")
    one = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = one.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")).select("text", "toxic").persist()
    try:
        sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        pos, neg = sizes.get(1, 0), sizes.get(0, 0)
        if not pos or not neg:
            return Lexicon()
        found = sample.mapInArrow(_count_stems, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        # an extension of an entry that has nearly all its texts is nearly as precise as the entry
        found = found.filter(F.expr(f"pos >= 3 AND pos >= {LEAST_PRECISION - 0.06} * (pos + neg)"))
        lexicon = Lexicon(choose({r.stem: (r.pos, r.neg) for r in found.collect()}, pos, neg))
        behind = sample.filter("toxic = 1").select("text").mapInArrow(_count_contexts(lexicon), "stem string, context string, n long").groupBy("stem", "context").agg(F.sum("n").alias("n"))
        spread = behind.groupBy("stem").agg((F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("contexts"))
        wide = {r.stem for r in spread.filter(F.col("contexts") >= LEAST_CONTEXTS).collect()}
        lexicon = Lexicon({k: w for k, w in lexicon.stems.items() if k in wide})
        clean = sample.mapInArrow(_count_phrases(lexicon), "phrase string, pos long, neg long").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("neg >= 3 AND pos = 0")
        lexicon.exceptions = frozenset(r.phrase for r in clean.collect())
        rows = sample.mapInArrow(_weigh_all(lexicon, ["toxic"]), "toxic int, weight double, words double, score double").collect()
        lexicon.curve = fit_curve(features(np.array([r.weight for r in rows]), np.array([r.words for r in rows])), np.array([r.toxic for r in rows], np.float64))
        return lexicon
    finally:
        sample.unpersist()


def assess(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, weight, words and score of every row."""
    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(_weigh_all(lexicon, ["doc_id"]), "doc_id long, weight double, words double, score double")


def _clean(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            both = [weigh(t, automaton, lexicon.exceptions) for t in batch.column(at).to_pylist()]
            total, words = np.array([b[0] for b in both]), np.array([b[1] for b in both], np.float64)
            yield batch.filter(pa.array(score(features(total, words), lexicon.curve) < 0.5))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score below one half, with all their columns."""
    return docs.mapInArrow(_clean(learn(docs, labels)), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = assess(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
