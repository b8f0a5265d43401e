"""Document fingerprints by winnowing.

Every k-gram of GRAM code points has a rolling hash; of each window of WINDOW consecutive hashes the
smallest is chosen, the rightmost of equal ones, and kept with its position.  Texts that share a run
of GRAM + WINDOW - 1 characters share a fingerprint entry.  A text shorter than GRAM has one entry
(its whole hash), an empty text none.  The fingerprint string lists ``hash.position`` entries in
hexadecimal, joined by one space; likeness is the Jaccard index of the sets of hashes (two empty ones: 1).

Edited texts: the last half of a text is replaced by the beginning of the next document's (falling
doc_id; after the last comes the first).  Documents are dealt once, by ranges of doc_id; the first
document of a range is also sent to the range before it, so no text is looked up elsewhere.  An id with
more rows than a range holds is split by a hash of the text.

Null text counts as empty.  Rows of equal id follow each other by a hash of their texts, then by text;
a null id is the smallest; rows equal in both are alike and stay in one range.  A single row is its own
next document.  An empty table gives an empty table, other columns don't matter.  A very long text is
hashed in blocks of BLOCK; of two equal hashes in a window the rightmost counts.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_id, slices, solid_id, table, text_key

GRAM, WINDOW = 8, 16
#: Code points that are hashed at once.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """Mixed 32-bit hashes of the k-grams, by doubling: hash of 2m characters = hash of m * BASE^m + hash of the next m."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.uint32)
    c += np.uint64(1)
    n = min(gram, len(c))
    done, x = 0, None
    part, width = c, 1
    while True:
        if n & width:
            if x is None:
                x, done = part, width
            else:
                size = min(len(x), len(part) - done)
                x = x[:size] * np.uint64(pow(BASE, width, 2**64)) + part[done : done + size]
                done += width
        if done == n:
            break
        part = part[:-width] * np.uint64(pow(BASE, width, 2**64)) + part[width:]
        width *= 2
    x = x[: len(c) - n + 1]
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen (hashes, positions), positions rising."""
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    key = (hashes.astype(np.uint64) << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))
    left, width = min(window, n), 1
    while width < left:
        step = min(width, left - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(32)).astype(np.uint32), (low - (key & low)).astype(np.int64)


def entries(text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Chosen (hashes, positions) of a text, in blocks that overlap by a window."""
    if len(text) <= block + GRAM + WINDOW:
        return winnow(gram_hashes(text))
    found = []
    for begin in range(0, len(text) - GRAM - WINDOW + 2, block):
        h, at = winnow(gram_hashes(text[begin : begin + block + GRAM + WINDOW - 2]))
        at = at + begin
        new = at > (found[-1][1][-1] if found else -1)
        found.append((h[new], at[new]) if new.any() else found.pop())
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The string, and the sorted distinct hashes."""
    h, at = entries(text)
    return " ".join(["%08x.%x" % x for x in zip(h.tolist(), at.tolist(), strict=True)]), np.unique(h)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


COLUMNS = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, ghost, id, text) in order; a ghost only follows."""
    before = None
    for batch in slices(batches, "text", 4_000_000):
        out: list[tuple] = []
        for part, ghost, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if before is not None and before[0] == part:
                at, last, last_text, print_, hashes = before
                own = (text, *fingerprint(text))
                changed = edited(last_text, text)
                string, few = fingerprint(changed)
                out.append((last, len(last_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), print_, string, likeness(hashes, few), likeness(hashes, own[2])))
            else:
                own = (text, *fingerprint(text))
            before = None if ghost else (part, doc, *own)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(COLUMNS.values())], list(COLUMNS))


def constant(value: list, kind: str) -> Column:
    """A list as one literal, however long it is."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def place(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` the value is at or above; two short searches."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = constant([bounds[i : i + step] for i in range(0, len(bounds), step)], "array<array<bigint>>")
    g = F.size(F.filter(constant(bounds[::step], "array<bigint>"), lambda h: h <= column))
    inside = F.size(F.filter(F.element_at(groups, F.greatest(g, F.lit(1))), lambda b: b <= column))
    return F.when(g == 0, F.lit(0)).otherwise((g - 1) * step + inside)


#: Ranges that one id may be split into.
SPLIT = 1 << 20


def neighbours(docs: DataFrame) -> DataFrame:
    """(part, ghost, id, th, text), each part with the first row of the next; parts fall by doc_id, then rise by the text's hash."""
    base = docs.select(solid_id().alias("id"), F.shiftrightunsigned(text_key(), 1).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # four ranges for each shuffle partition, so that dealing them by hash comes out even
    parts = 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = base.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] or []
    bounds, hot = sorted(set(cuts)), {k: min(n, SPLIT - 1) for k, n in Counter(cuts).items() if n > 1}
    # numbered so that they rise in the order of the rows: SPLIT numbers for a range, the first for what lies above its bound
    part = (F.lit(len(bounds)) - (place(F.col("id"), bounds) if bounds else F.lit(0))).cast("long") * SPLIT
    if hot:
        pieces = F.element_at(F.from_json(F.lit(json.dumps({str(k): n for k, n in hot.items()})), "map<string,int>"), F.col("id").cast("string"))
        part = part + F.coalesce(F.floor(F.col("th") / F.lit(2.0**63) * F.try_add(pieces, F.lit(0))).cast("long") + 1, F.lit(0))
    dealt = base.withColumn("part", part)
    heads = dealt.groupBy("part").agg(F.max(F.struct("id", (-F.col("th")).alias("th"))).alias("head")).orderBy("part").collect()
    if not heads:
        return base.select(F.lit(0).cast("long").alias("part"), F.lit(False).alias("ghost"), "id", "th", "text")
    # three numbers for each part: the head of a part also goes to the part before it, in a circle
    to = [(r.head.id, -r.head.th, heads[i - 1].part) for i, r in enumerate(heads)]
    ghosts = docs.sparkSession.createDataFrame(to, "head long, head_th long, to long")
    own = dealt.join(F.broadcast(ghosts), (F.col("id") == F.col("head")) & (F.col("th") == F.col("head_th")), "left")
    here = F.struct("part", F.lit(False).alias("ghost"))
    both = F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("to").alias("part"), F.lit(True).alias("ghost"))))
    return own.select(F.inline(both), "id", "th", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    dealt = neighbours(docs).repartition("part").sortWithinPartitions("part", "ghost", F.desc("id"), "th", "text")
    return dealt.select("part", "ghost", "id", "text").mapInArrow(_walk, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumn("doc_id", plain_id("id")).select("doc_id", *[c for c in COLUMNS if c != "id"])
