"""Removal of repeated word windows by super-k-mer partitioning.

A document is a sequence of words ``[^\\x20\\x09-\\x0D]+``; a window is ``WINDOW`` consecutive
words.  The minimiser of a window is its m-gram of words with the smallest hash (leftmost on
ties).  Consecutive windows that share one minimiser occurrence form a super-k-mer.

1. Each document gives a light row (minimiser hash, id, first window, windows) per super-k-mer.
   Two equal windows have equal minimisers, so a minimiser that occurs once proves that all its
   windows are unique: only super-k-mers whose minimiser occurs again go on.
2. Those travel as one packed string each to the bucket of their minimiser, after equal strings of
   one batch were merged.  A bucket sorts its windows and so finds the first place of each exactly.
   A minimiser with more than ``HOT`` occurrences has no bounded bucket: its packed strings are
   dealt by their own hash, merged, and cut into windows which a partially aggregated groupBy
   (128-bit BLAKE2 keys) resolves.  Both ways give the same result.
3. Windows in repeated super-k-mers that aren't first are duplicates; the words they cover go.

Null text counts as empty.  A text of fewer than ``WINDOW`` words keeps all words.  A document is an id
with its text: rows that are equal in both are one document and get equal results.  Rows that share an
id (a null id too) but not the text are documents of their own, in the order of a hash of their texts;
a null id sorts before all others.  An empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, plain_id, slices, solid_id, text_key

WINDOW = 20
#: Words in a minimiser; WINDOW - MINI + 1 is 16, a power of two, for the sliding minimum.
MINI = 5
#: Occurrences of a minimiser from which its bucket is split.
HOT = 1000
#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


def joined(text: bytes | None) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join(text.split()) if text else b""


class Words:
    """Words joined by one space, with where each begins and ends."""

    def __init__(self, line: bytes):
        self.line = line
        self.bytes = np.frombuffer(line, np.uint8)
        gaps = np.flatnonzero(self.bytes == 32)
        self.starts = np.concatenate(([0], gaps + 1)) if line else gaps
        self.ends = np.append(gaps, len(line)) if line else gaps

    def __len__(self) -> int:
        return len(self.starts)

    def without(self, gone: np.ndarray) -> bytes:
        """The words that aren't gone, joined by one space."""
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
        return b" ".join([self.line[a:b] for a, b in zip(self.starts[edge[::2]].tolist(), self.ends[edge[1::2] - 1].tolist(), strict=True)])


class Powers:
    """Powers of PRIME and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up))
            factors = [np.full(size, x, np.uint64) for x in (int(PRIME), pow(int(PRIME), -1, 2**64))]
            for f in factors:
                f[0] = 1
            self.up, self.down = (np.cumprod(f) for f in factors)
        return self.up, self.down


def word_hashes(words: Words, powers: Powers) -> np.ndarray:
    """A hash of each word from running sums of its bytes: no Python object for a word."""
    out, first = [], 0
    while first < len(words):
        base = words.starts[first]
        last = max(first + 1, int(np.searchsorted(words.ends, base + BLOCK, "right")))
        starts, ends = words.starts[first:last] - base, words.ends[first:last] - base
        up, down = powers.get(int(ends[-1]))
        sums = np.zeros(ends[-1] + 1, np.uint64)
        np.cumsum((words.bytes[base : base + ends[-1]].astype(np.uint64) + np.uint64(1)) * up[: ends[-1]], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def super_kmers(lines: list[bytes], powers: Powers, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, number of the line, first window, windows) of each super-k-mer of lines of joined words."""
    sizes = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    words = Words(b" ".join([x for x in lines if x]))
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    h = word_hashes(words, powers)
    x = h[: len(h) - MINI + 1].copy()
    for j in range(1, MINI):
        x *= PRIME
        x += h[j : len(h) - MINI + 1 + j]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    low = np.uint64(0xFFFFFF)
    key = (x & ~low) | (np.arange(len(x), dtype=np.uint64) & low)
    left, width = window - MINI + 1, 1
    while width < left:
        step = min(width, left - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    line = np.repeat(np.arange(len(lines)), sizes)
    whole = line[:n] == line[window - 1 :]  # windows within one line
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:n] != line[: n - 1]) | (whole[1:] != whole[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))[whole[first]]
    first = first[whole[first]]
    i = first.astype(np.uint64)
    place = i + (((key[first] & low) - i) & low)
    begin = np.cumsum(sizes) - sizes
    return x[place.astype(np.int64)].view(np.int64), line[first], first - begin[line[first]], size


def marks_of(column: pa.ListArray) -> Iterator[dict[str, np.ndarray] | None]:
    """The fields of each row's list of structs as arrays; None for none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    inside = column.values
    fields = {inside.type.field(k).name: inside.field(k).to_numpy(zero_copy_only=False) for k in range(inside.type.num_fields)}
    offsets = column.offsets.to_numpy()
    for known, a, b in zip(column.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield {name: values[a:b] for name, values in fields.items()} if known and b > a else None


def _light(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in slices(batches, "text", BLOCK):
        ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        h, line, first, n = super_kmers([joined(t) for t in as_bytes(batch.column(2))], powers)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[line]), pa.array(keys[line]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "id", "th", "start", "n"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings of the marked super-k-mers; equal ones of a batch are merged to the first place."""
    for batch in slices(batches, "text"):
        best: dict[tuple[int, bool, bytes], tuple[int, int, int]] = {}
        for doc, th, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), marks_of(batch.column(3)), strict=True):
            if marks is None:
                continue
            words = Words(joined(text))
            starts, ends = words.starts, words.ends
            to = marks["start"] + marks["n"] + (WINDOW - 2)
            for h, hot, start, a, b in zip(*(marks[x].tolist() for x in ("h", "hot", "start")), starts[marks["start"]].tolist(), ends[to].tolist(), strict=True):
                key = (h, hot, words.line[a:b])
                place = (doc, th, start)
                if best.get(key, place) >= place:
                    best[key] = place
        rows = list(best)
        bucket = [xxhash.xxh64_intdigest(p) - 2**63 if hot else h for h, hot, p in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary()), *(pa.array([p[k] for p in best.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32())))],
            ["bucket", "hot", "packed", "id", "th", "start"],
        )


def windows(packed: bytes, window: int = WINDOW) -> list[bytes]:
    """The windows of a packed string, in order."""
    ends = [i for i, c in enumerate(packed) if c == 32]
    ends.append(len(packed))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [packed[starts[i] : ends[i + window - 1]] for i in range(len(ends) - window + 1)]


def _cold(rows: list[tuple[bytes, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """First places of the windows of a bucket, as runs (id, text's hash, start, n)."""
    best: dict[bytes, tuple[int, int, int]] = {}
    for packed, *place in rows:
        if best.get(packed, (place := tuple(place))) >= place:
            best[packed] = place
    if len(best) == 1:
        (packed, place) = next(iter(best.items()))
        return [(*place, packed.count(b" ") + 2 - WINDOW)]
    seen = sorted((w, doc, th, start + i) for packed, (doc, th, start) in best.items() for i, w in enumerate(windows(packed)))
    places = sorted(x[1:] for i, x in enumerate(seen) if not i or seen[i - 1][0] != x[0])
    runs: list[tuple[int, int, int, int]] = []
    for doc, th, start in places:
        if runs and runs[-1][:2] == (doc, th) and runs[-1][2] + runs[-1][3] == start:
            runs[-1] = (doc, th, runs[-1][2], runs[-1][3] + 1)
        else:
            runs.append((doc, th, start, 1))
    return runs


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Resolve buckets, of which the rows come together; (key, id, th, start, n), keys of hot windows may come again."""
    out: list[tuple[bytes, int, int, int, int]] = []

    def close(hot: bool, rows: list[tuple[bytes, int, int, int]]) -> None:
        if hot:
            for packed, doc, th, start in rows:
                out.extend((hashlib.blake2b(w, digest_size=16).digest(), doc, th, start + i, 1) for i, w in enumerate(windows(packed)))
        else:
            out.extend((struct.pack("<qqi", *run[:3]), *run) for run in _cold(rows))

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "id", "th", "start", "n"])
        out.clear()
        return made

    now: tuple[int, bool] | None = None
    rows: list[tuple[bytes, int, int, int]] = []
    for batch in batches:
        for bucket, hot, packed, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, hot) != now:
                if now is not None:
                    close(now[1], rows)
                now, rows = (bucket, hot), []
                if len(out) > 50_000:
                    yield flush()
            # sorted by bucket, hot, packed: of equal strings only the first place is held
            if rows and rows[-1][0] == packed:
                if tuple(place) < rows[-1][1:]:
                    rows[-1] = (packed, *place)
            else:
                if hot and rows:
                    close(True, rows)
                    rows = []
                rows.append((packed, *place))
    if now is not None:
        close(now[1], rows)
    yield flush()


def duplicate_words(n_words: int, marks: dict[str, np.ndarray] | None, window: int = WINDOW) -> np.ndarray | None:
    """Mask of words covered by a repeated window that isn't the first of its kind; None if there is none."""
    n = n_words - window + 1
    if marks is None or n <= 0:
        return None
    counts = []
    for first in (False, True):
        own = marks["first"] == first
        edge = np.zeros(n + 1, np.int32)
        a = np.minimum(marks["start"][own], n)
        np.add.at(edge, a, 1)
        np.add.at(edge, np.minimum(a + marks["n"][own], n), -1)
        counts.append(np.cumsum(edge[:-1]) > 0)
    dup = np.flatnonzero(counts[0] & ~counts[1])
    if not len(dup):
        return None
    edge = np.zeros(n_words + 1, np.int32)
    edge[dup] += 1
    edge[dup + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out = [[], [], [], []]
        for doc, text, marks in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), marks_of(batch.column(2)), strict=True):
            line = joined(text)
            n = line.count(b" ") + 1 if line else 0
            gone = duplicate_words(n, marks)
            for to, x in zip(out, (doc, n, 0 if gone is None else int(gone.sum()), line if gone is None else Words(line).without(gone)), strict=True):
                to.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])


def remove_repeated_windows(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of each document (joined by one space)."""
    base = docs.select(solid_id().alias("id"), text_key().alias("th"), "text")
    light = base.mapInArrow(_light, "h long, id long, th long, start int, n int")
    # the flipped hash keeps the join's own shuffle apart from the count's, so that AQE can split a frequent one
    again = light.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select(F.bitwise_not("h").alias("flip"), "c")
    marks = materialize(light.withColumn("flip", F.bitwise_not("h")).join(again, "flip").select("id", "th", "start", "n", "h", (F.col("c") > hot).alias("hot")))
    grouped = marks.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n", "h", "hot")).alias("marks"))
    packed = base.join(grouped, ["id", "th"]).select("id", "th", "text", "marks").mapInArrow(_pack, "bucket long, hot boolean, packed binary, id long, th long, start int")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "hot", "packed")
    found = dealt.mapInArrow(_buckets, "key binary, id long, th long, start int, n int")
    first = found.groupBy("key").agg(F.min(F.struct("id", "th", "start", "n")).alias("f")).select("f.*", F.lit(True).alias("first"))
    every = marks.select("id", "th", "start", "n", F.lit(False).alias("first")).unionByName(first)
    spans = every.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n", "first")).alias("marks"))
    out = base.join(spans, ["id", "th"], "left").select("id", "text", "marks").mapInArrow(_finish, "id long, n_words long, n_removed long, kept string")
    return out.select(plain_id("id").alias("doc_id"), "n_words", "n_removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
first AS (SELECT k, min((doc_id, i)) AS f FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS spots FROM win JOIN first USING (k), unnest(range(0, {WINDOW})) AS t(j) WHERE (doc_id, i) > f GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, CASE WHEN spots IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(spots, p)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
