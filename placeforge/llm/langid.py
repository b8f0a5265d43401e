"""Language identification by rank-order profiles of letter n-grams.

A text's profile is its TOP most frequent n-grams (one to three letters of lower-cased words, a
word's ends marked by a space), ranked by falling count, then by code.  The distance to a language's
profile sums, over the text's n-grams, how far each rank is out of place; an n-gram that the
language lacks costs TOP.  The language with the smallest distance wins (then the smaller name).
The score is the relative lead before the second language, 1 if there is only one.

Profiles are fitted on about ``most`` labelled rows at most (a bounded sample by a hash of id and text),
dealt evenly to the languages, so that a language with few rows keeps them all; there are ``top`` numbers
a language, however many documents.  A null text or one without a letter is ``und`` with score 0, as is
every text if no language is known.  Of equally frequent n-grams the smaller code comes first, of equally
near languages the smaller name.  Rows are independent: null and repeated ids give a row each, other
columns don't matter, an empty table gives an empty table.  A long text is counted in blocks of BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialize, slices, table

#: N-grams in a profile.
TOP = 400
#: Labelled rows that the profiles are fitted on, about.
MOST_ROWS = 12_000
#: Languages up to which their shares are broadcast, and rows that each may have at least.
MOST_LANGUAGES, LEAST_ROWS = 10_000, 50
#: Code points that are counted at once.
BLOCK = 1 << 20
NONE = "und"


class Letters:
    """Which code points are letters; made once a worker."""

    def __init__(self):
        self.table = np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)

    def marked(self, text: str) -> np.ndarray:
        """Code points, 32 for what isn't a letter."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.table[np.minimum(c, 0x2FFFF)]
        far = np.flatnonzero(c >= 0x30000)
        if len(far):
            letter[far] = [chr(x).isalpha() for x in c[far].tolist()]
        return np.where(letter, c, 32).astype(np.uint64)

    def codes(self, text: str) -> np.ndarray:
        """Code points with each run of other characters as one 32, also at both ends; empty without a letter."""
        c = self.marked(text.lower())
        return runs(np.concatenate(([32], c, [32])).astype(np.uint64)) if (c != 32).any() else np.zeros(0, np.uint64)

    def counts(self, text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """As ``grams(codes(text))``, in blocks."""
        if len(text) <= block:
            return grams(self.codes(text))
        text = text.lower()
        kept, sums = np.array([32], np.uint64), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for at in range(0, len(text) + 1, block):
            own = self.marked(text[at : at + block]) if at < len(text) else np.zeros(0, np.uint64)
            end = [32] if at + block > len(text) else []
            c = runs(np.concatenate((kept, own, end)).astype(np.uint64))
            found = grams(c, len(kept))
            codes, to = np.unique(np.concatenate((sums[0], found[0])), return_inverse=True)
            sums = codes, np.bincount(to, np.concatenate((sums[1], found[1])), len(codes)).astype(np.int64)
            kept = c[-2:]
        return sums


def runs(c: np.ndarray) -> np.ndarray:
    """The codes with each run of 32 as one."""
    gap = c == 32
    return c[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]


def grams(c: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three code points that end beyond the first ``known``, and their counts; a lone space is none."""
    s = np.uint64(21)
    one = c[known:]
    two = (c[:-1] << s) | c[1:]
    three = (two[:-1] << s) | c[2:]
    three = three[max(known - 2, 0) :][c[1:-1][max(known - 2, 0) :] != 32]
    every = np.concatenate((one[one != 32], two[max(known - 1, 0) :], three))
    every.sort()
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    return every[at], np.diff(np.append(at, len(every)))


def profile(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` n-grams by falling count, then rising code."""
    if len(codes) > 4 * top:  # the rest can't be among them
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


class Ranks:
    """The profiles as one sorted table of n-grams with a rank for each language."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.names, self.top, self.letters = sorted(profiles), top, Letters()
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, np.array(profiles[name], np.uint64)), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.letters.counts(text) if text and self.names else ((), ())
        if not len(found[0]):
            return NONE, 0.0
        own = profile(*found, self.top)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.rank[at]
        far = np.where(rank < 0, self.top, np.abs(rank - np.arange(len(own), dtype=np.int32)[:, None])).sum(0)
        best = int(np.argmin(far))
        if len(far) == 1:
            return self.names[0], 1.0
        second = float(np.delete(far, best).min())
        return self.names[best], (second - float(far[best])) / second if second else 0.0


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = Letters()
    for batch in slices(batches, "text"):
        sums: dict[str, list] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums.setdefault(lang, []).append(letters.counts(text))
        for lang, found in sums.items():
            codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([f[1] for f in found]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def learn(docs: DataFrame, most: int = MOST_ROWS, top: int = TOP) -> dict[str, list[int]]:
    """Profiles by language, from labelled rows outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    sizes = materialize(known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")))
    names = sizes.count()
    share = F.least(F.lit(1.0), F.lit(max(LEAST_ROWS, most / max(names, 1))) / F.col("n"))
    shares = sizes.select("of", (share * 1_000_000).alias("share"))
    known = known.join(F.broadcast(shares) if names <= MOST_LANGUAGES else shares, F.col("lang") == F.col("of"))
    known = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share"))
    counts = known.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.gram)
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(profiles, top)
        for batch in slices(batches, "text"):
            found = [ranks.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
