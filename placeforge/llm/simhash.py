"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing.

Fingerprint: A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``; each shingle of ``size`` words
(repeats included; the whole sequence if there are fewer) is hashed by XXH64 with seed 42, and a
fingerprint bit is set if it is set in over half of the hashes.  No words give 0.

Links at up to RADIUS = 3 differing bits are found by covering LSH: every bit position has a
nonzero vector of F2^4, and table v (15 nonzero vectors) keeps the bits whose vector has an odd
product with v.  Three differing bits span at most 3 of 4 dimensions, so some v is orthogonal to
all of them: in that table the two fingerprints have equal keys.  No pair within the radius is lost.

Equal fingerprints are one node (their smallest id).  A bucket of at most ``most`` fingerprints is
compared in its task.  Larger ones are dealt again by four blocks of the remaining bits (of four
blocks at least one is equal at three differences), and what is still larger is searched by sorted
look-ups of all neighbours within the radius, which is linear in the bucket.  Such a sub-bucket agrees in
40 bits or so, and its fingerprints are distinct: 2^24 of them at most, whatever the table's size.  A
bucket gives only the links of a spanning forest, never all pairs.

Rows: a null text counts as empty; a null id takes part, is smaller than no other id and never names
a component unless alone; rows that repeat an id are one node, with the fingerprints of all its texts.
Other columns don't matter; an empty table gives an empty table.  A very long text is hashed as a whole
by one task, in blocks of its shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, few, materialize, slices
from .components import components

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Fingerprints in a bucket that are compared with each other directly.
DIRECT = 2000
#: Minhash values that make a band key, and bands.
ROWS, BANDS = 6, 24
#: Sets of a group that are compared without a prefix filter, and shingles of a group that one task holds.
GROUP, BLOCK = 200, 2_000_000
#: Shingles of a batch of sets of which the prefixes are found together.
BATCH = 200_000
#: Ids that go up to which they are broadcast.
MOST_GONE = 200_000


def masks() -> list[int]:
    """The 15 masks; bit i has the vector (i mod 15) + 1 of F2^4."""
    return [sum(1 << i for i in range(64) if (((i % 15) + 1) & v).bit_count() & 1) for v in range(1, 16)]


def blocks(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """The bits outside ``mask`` in ``parts`` blocks."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in rest[p::parts]) for p in range(parts)]


MASKS = masks()
BLOCKS = [blocks(m) for m in MASKS]


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(sizes)))
    ends = (start[size:] - 1).tolist()
    return np.fromiter((h(line[a:b], seed) for a, b in zip(start.tolist(), ends, strict=False)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit, strictly over half; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(shingle_hashes((t or b"").lower().split(), size)) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(size), "doc_id long, fp long")


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """15 rows (table, key, rep, fp) for each node."""
    for batch in batches:
        rep, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(fp)
        keys = np.concatenate([fp.view(np.uint64) & np.uint64(m) for m in MASKS]).view(np.int64) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(15, dtype=np.int32), n)), pa.array(keys), pa.array(np.tile(rep, 15)), pa.array(np.tile(fp, 15))], ["t", "key", "rep", "fp"])


def _again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four rows for each row of a large bucket: table and key get the block and its bits."""
    for batch in batches:
        t, key, rep, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        out = [[], [], [], []]
        for table in np.unique(t):
            own = t == table
            for p, block in enumerate(BLOCKS[table]):
                bits = np.uint64(MASKS[table] | block)
                for to, x in zip(out, (np.full(own.sum(), 15 + table * 4 + p, np.int32), (fp[own].view(np.uint64) & bits).view(np.int64), rep[own], fp[own]), strict=True):
                    to.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["t", "key", "rep", "fp"])


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(fp: np.ndarray, free: int, direct: int = DIRECT) -> list[tuple[int, int]]:
    """A spanning forest of the links within RADIUS among distinct fingerprints; they differ in ``free`` bits only."""
    n, forest, out = len(fp), Forest(len(fp)), []
    if n <= direct:
        for i in range(n - 1):
            for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= RADIUS) + i + 1).tolist():
                if forest.join(i, j):
                    out.append((i, j))
        return out
    order = np.argsort(fp)
    ordered = fp[order]
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    for k in range(1, RADIUS + 1):
        for change in combinations(bits, k):
            flip = np.bitwise_or.reduce(np.array(change, np.uint64))
            to = np.searchsorted(ordered, ordered ^ flip)
            to[to == n] = 0
            for a in np.flatnonzero(ordered[to] == ordered ^ flip).tolist():
                if a < to[a] and forest.join(int(order[a]), int(order[to[a]])):
                    out.append((int(order[a]), int(order[to[a]])))
    return out


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of buckets, of which the rows come together."""
    held: list[np.ndarray] = [np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))]

    def links(t, key, rep, fp) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])))) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(t)))
        a, b = [], []
        s = cut[np.flatnonzero(size == 2)]
        s = s[np.bitwise_count(fp[s].view(np.uint64) ^ fp[s + 1].view(np.uint64)) <= RADIUS] if len(s) else s
        a.extend(rep[s].tolist())
        b.extend(rep[s + 1].tolist() if len(s) else [])
        for i in np.flatnonzero(size > 2).tolist():
            s, e = cut[i], cut[i] + size[i]
            table = int(t[s])
            kept = MASKS[table] if table < 15 else MASKS[(table - 15) // 4] | BLOCKS[(table - 15) // 4][(table - 15) % 4]
            for x, y in bucket_links(fp[s:e].view(np.uint64), ~kept & (2**64 - 1)):
                a.append(rep[s + x])
                b.append(rep[s + y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate((x, y)) for x, y in zip(held, new, strict=True)]
        t, key = held[0], held[1]
        if not len(t):
            continue
        last = np.flatnonzero((t != t[-1]) | (key != key[-1]))
        at = last[-1] + 1 if len(last) else 0
        if at:
            yield links(*(x[:at] for x in held))
            held = [x[at:] for x in held]
    yield links(*held)


def hamming_links(nodes: DataFrame, most: int = DIRECT) -> DataFrame:
    """Links (a, b) between nodes (rep, fp) of distinct fingerprints: a spanning set of all pairs within RADIUS."""
    dealt = nodes.select("rep", "fp").mapInArrow(_tables, "t int, key long, rep long, fp long")
    # the flipped key keeps the join's own shuffle apart from the count's, so that AQE can split a large bucket
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("c")).filter(F.col("c") > 1).select("t", F.bitwise_not("key").alias("flip"), "c")
    shared = materialize(dealt.withColumn("flip", F.bitwise_not("key")).join(sizes, ["t", "flip"]).select("t", "key", "rep", "fp", "c"))
    cold = shared.filter(F.col("c") <= most).drop("c")
    hot = shared.filter(F.col("c") > most).drop("c").mapInArrow(_again, "t int, key long, rep long, fp long")
    rows = cold.unionByName(hot).repartition("t", "key").sortWithinPartitions("t", "key", "rep")
    return rows.mapInArrow(_compare, "a long, b long")


def classes(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp); ``more`` holds further links (a, b) between ids."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    known = nodes.filter("rep IS NOT NULL")
    links = hamming_links(known)
    if more is not None:
        home = prints.join(nodes, "fp").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "rep").distinct()
        far = more.join(home.withColumnRenamed("rep", "ra"), F.col("a") == F.col("id")).drop("id").join(home.withColumnRenamed("rep", "rb"), F.col("b") == F.col("id"))
        links = links.union(far.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    found = components(links)
    named = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    prints = materialize(fingerprints(docs, size))
    return classes(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))


def _digest(hashes: np.ndarray) -> int:
    """Names a shingle set; -2**63 <= digest < 2**63."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63


def _bands(size: int):
    """(doc_id, fp, key, n, band keys) of each row; key names its set of n distinct shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        mul, add = (rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) for _ in range(2))
        mul |= np.uint32(1)
        for batch in slices(batches, "text"):
            fps, keys, sizes, bands = [], [], [], []
            for t in as_bytes(batch.column(1)):
                h = shingle_hashes((t or b"").lower().split(), size)
                fps.append(fingerprint(h))
                own = np.unique(h)
                keys.append(_digest(own))
                sizes.append(len(own))
                low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
                least = np.full(ROWS * BANDS, 2**32 - 1, np.uint32)
                for i in range(0, len(low), 1024):
                    x = low[i : i + 1024, None] * mul + add
                    x ^= x >> np.uint32(15)
                    x *= np.uint32(0x2C1B3C6D)
                    x ^= x >> np.uint32(12)
                    np.minimum(least, x.min(0), out=least)
                raw = least.tobytes()
                bands.append([xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], b) - 2**63 for b in range(BANDS)] if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "fp", "key", "n", "bands"])

    return run


def _sets(size: int):
    """(key, shingle set as sorted 64-bit hashes) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes((t or b"").lower().split(), size)) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "set"])

    return run


def _batch_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, token, c): the distinct shingles of the sets of a batch b, of which the rows (b, set) come together."""
    now, held = None, []

    def close() -> pa.RecordBatch:
        names, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([now] * len(names), pa.int64()), pa.array(names), pa.array(counts.astype(np.int64))], ["b", "token", "c"])

    for batch in batches:
        for b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != now:
                yield close()
                now, held = b, []
            held.append(np.frombuffer(own, np.int64))
    yield close()


def _prefixes(least: float):
    """(g, key, n) of a batch: its sets (b, key, set) with what is known of its shingles (b, token, c)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, counts = (right.column(k).to_numpy() for k in ("token", "c"))
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        out: list[tuple] = []
        for key, own in zip(left.column("key").to_pylist(), left.column("set").to_pylist(), strict=True):
            own = np.frombuffer(own, np.int64)
            at = np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))
            shared = names[at] == own if len(names) else np.zeros(len(own), bool)
            # shingles of one set alone come first: they count in the prefix but make no group
            first = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1 - int((~shared).sum())
            if first > 0:
                mine, c = own[shared], counts[at[shared]]
                out.extend((int(t), key, len(own)) for t in mine[np.lexsort((mine, c))[:first]].tolist())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["g", "key", "n"])

    return run


def overlapping(sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` with an exact Jaccard index of ``least`` or more.

    With two values in ``side`` only pairs across are compared.  Pairs that are linked already, or
    whose sizes rule out the overlap, are passed over; every other pair is counted.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    side = side[order]
    cross = side[0] != side[-1] or len(np.unique(side)) > 1
    at = np.concatenate(([0], np.cumsum(size)))
    names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    marks, label, out = np.zeros(len(names), np.int32), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size * least, size[i] + 1e-9, "right"))
        todo = label[i + 1 : end] != label[i]
        if cross:
            todo &= side[i + 1 : end] != side[i]
        if not todo.any():
            continue
        own = flat[at[i] : at[i + 1]]
        marks[own] = 1
        if 4 * todo.sum() < len(todo):
            both = np.zeros(len(todo), np.int64)
            for j in np.flatnonzero(todo):
                both[j] = marks[flat[at[i + 1 + j] : at[i + 2 + j]]].sum()
        else:
            both = np.add.reduceat(marks[flat[at[i + 1] : at[end]]], at[i + 1 : end] - at[i + 1])
        marks[own] = 0
        for j in (np.flatnonzero(todo & (both >= least * (size[i] + size[i + 1 : end] - both) - 1e-9)) + i + 1).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _confirm(least: float):
    """Links (a, b) of groups (g, lo, hi), of which the rows (g, lo, hi, side, rep, set) come together."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        reps = [r[0] for r in rows]
        return [(reps[i], reps[j]) for i, j in overlapping([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows]), least)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            found = []
            for g, lo, hi, side, rep, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, lo, hi) != last:
                    found += links(held)
                    held, last = [], (g, lo, hi)
                held.append((rep, side, own))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = links(held)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def groups(rows: DataFrame) -> DataFrame:
    """(g, key, c, w) of the groups of ``rows`` (g, key, n) with c > 1 keys and w shingles; of groups with the same keys one is left."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.sum("n").alias("w")).filter("c > 1")
    one = sizes.groupBy("c", "x", "y").agg(F.min("g").alias("g"), F.max("w").alias("w"))
    # the flipped key keeps the join's own shuffle apart from the count's, so that AQE can split a large group
    one = one.select(F.bitwise_not("g").alias("flip"), "c", "w")
    return rows.withColumn("flip", F.bitwise_not("g")).join(one, "flip").select("g", "key", "c", "w")


def prefix_groups(sets: DataFrame, least: float, batch: int = BATCH) -> DataFrame:
    """(g, key, n): the first shingles of each set (key, n, set), rare ones first, as many as an overlap of ``least`` can't do without.

    Two sets with that overlap share a shingle of both prefixes.  How often a shingle comes is looked up
    once for each batch of sets (of ``batch`` shingles or so), not for each set: near copies share theirs.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    many = max(8, -(-total // batch))
    dealt = sets.select(F.pmod(F.xxhash64("key"), F.lit(many)).alias("b"), "key", "set")
    tokens = materialize(dealt.select("b", "set").repartition("b").sortWithinPartitions("b").mapInArrow(_batch_tokens, "b long, token long, c long"))
    counts = tokens.groupBy("token").agg(F.sum("c").alias("c")).filter("c > 1").select(F.bitwise_not("token").alias("flip"), F.col("c").alias("uses"))
    known = tokens.select("b", "token", F.bitwise_not("token").alias("flip")).join(counts, "flip").select("b", "token", F.col("uses").alias("c"))
    return materialize(dealt.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(_prefixes(least), "g long, key long, n int"))


def overlap_links(texts: DataFrame, distinct: DataFrame, prints: DataFrame, least: float, size: int, most: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span all pairs of candidates with an exact shingle overlap of ``least`` or more.

    Candidates are the sets (``distinct``: key, n, bands, rep) that share a band key or a SimHash
    class (``prints``: key, component_id).  All pairs of a group of at most ``most`` sets are
    compared; larger groups are dealt again by the prefixes of their sets, whatever size these have
    then.  A group of over ``block`` shingles is compared by pairs of its blocks.
    """
    alike = prints.select(F.xxhash64("component_id", F.lit("class")).alias("g"), "key").distinct().join(distinct.filter("n > 0").select("key", "n"), "key")
    rows = distinct.select(F.explode(F.array_distinct("bands")).alias("g"), "key", "n").unionByName(alike)
    shared = materialize(groups(rows))
    wanted = shared.select("key").distinct().join(distinct.select("key", "rep"), "key")
    made = texts.join(wanted.select("rep").distinct(), texts["doc_id"] == F.col("rep")).select("doc_id", "text").mapInArrow(_sets(size), "key long, set binary")
    # an id may have several texts, and a text several rows
    sets = materialize(made.join(wanted, "key").groupBy("key", "rep").agg(F.first("set").alias("set")))
    hot = sets.join(shared.filter(F.col("c") > most).select("key").distinct(), "key", "left_semi").withColumn("n", F.expr("octet_length(set) DIV 8"))
    small = shared.filter(F.col("c") <= most).select("g", "key", "w")
    dealt = small.unionByName(groups(prefix_groups(hot, least)).select(F.xxhash64("g", F.lit("prefix")).alias("g"), "key", "w"))
    k = F.ceil(F.col("w") / block).cast("int")
    spread = dealt.withColumn("k", k).withColumn("side", F.pmod(F.xxhash64("key", "g"), F.col("k")).cast("int"))
    spread = spread.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    spread = spread.select("g", F.least("side", "to").alias("lo"), F.greatest("side", "to").alias("hi"), "side", "key")
    laid = spread.join(sets, "key").select("g", "lo", "hi", "side", "rep", "set")
    return laid.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(_confirm(least), "a long, b long")


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each class only the row with the smallest id stays.

    Classes are closed over links of texts whose sets of ``size``-word shingles have an exact Jaccard
    index of ``similarity`` or more.  Candidates are texts of one SimHash class (equal fingerprints
    and those within RADIUS bits, covering LSH) and texts that share a minhash band key: an overlap of
    0.8 leaves about ten of 64 bits different, which no covering tables reach at a bearable number.
    Rows with a null id stay.  Of rows that share an id all stay or go together, but for rows that are equal in id and text.
    """
    base = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL")
    made = materialize(base.mapInArrow(_bands(size), "doc_id long, fp long, key long, n int, bands array<long>"))
    distinct = materialize(made.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    prints = made.select("key", "fp").distinct().join(classes(made.select("doc_id", "fp")).select("fp", "component_id").distinct(), "fp")
    found = components(overlap_links(base, distinct, prints, similarity, size))
    named = distinct.select("key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    gone = few(made.select("key", "doc_id").join(named, "key").filter("doc_id <> component_id").select(F.col("doc_id").alias("near_duplicate_id")).distinct(), MOST_GONE)
    discard(made)
    discard(distinct)
    return docs.join(gone, docs["doc_id"] == gone["near_duplicate_id"], "left_anti")
