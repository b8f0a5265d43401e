"""Token counts that follow edits: pre-token segment trees.

A document's pre-tokens are grouped into leaves; a binary tree over the leaves sums characters,
pre-tokens and tokens.  An edit goes down the tree to the leaves that it touches, splits and encodes
again only from the last boundary CONTEXT characters before it to the first old boundary after it at
which old and new splitting agree, and updates the sums on the way up.  The pattern looks ahead two
characters at most and never back, so from that boundary on all pre-tokens are the old ones.

:func:`trees` makes a table of the trees, and :func:`edit_trees` edits such a table: what it keeps is
neither split nor encoded again.  :func:`count_edits` does both at once.

A null text counts as empty.  Null edits are none; an edit's position and length are clipped to the text.
Rows are independent: null and repeated ids give a row each, other columns don't matter, an empty
table gives an empty table.  A very long text is held once with its tree by the task that counts it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .tokenizer import CACHE, LONGEST, PATTERN, VOCABULARY, encoding, ship

LEAF, CONTEXT = 32, 3
SPLIT = regex.compile(PATTERN)
EDITS = "array<struct<pos:int,deleted:int,inserted:string>>"


class Counts(dict):
    """Tokens of a pre-token, remembered up to a bound of short ones."""

    def __init__(self, vocabulary: bytes):
        self.encode = encoding(vocabulary).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n


class Tree:
    """Sums over leaves of pre-tokens; level 0 has the leaves, the last level the root."""

    def __init__(self, text: str, counts: Counts):
        self.counts, self.encoded = counts, 0
        self.grow(SPLIT.findall(text))

    @classmethod
    def kept(cls, leaves: list[dict], counts: Counts) -> Tree:
        """The tree of :meth:`stored` leaves."""
        tree = cls.__new__(cls)
        tree.counts, tree.encoded, tree.leaves = counts, 0, []
        for leaf in leaves:
            at, pieces = 0, []
            for size, n in zip(leaf["sizes"], leaf["tokens"], strict=True):
                pieces.append(leaf["text"][at : at + size])
                at += size
                if size <= LONGEST and len(counts) < CACHE:
                    counts.setdefault(pieces[-1], n)
            tree.leaves.append(pieces)
        tree.sum_up([(len(leaf["text"]), len(leaf["sizes"]), sum(leaf["tokens"])) for leaf in leaves])
        return tree

    def stored(self) -> list[dict]:
        """The leaves: text, and characters and tokens of each pre-token."""
        return [{"text": "".join(leaf), "sizes": [len(p) for p in leaf], "tokens": [self.counts[p] for p in leaf]} for leaf in self.leaves]

    def grow(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.sum_up([self.sums(leaf) for leaf in self.leaves])

    def sum_up(self, leaves: list[tuple[int, int, int]]) -> None:
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            last = self.levels[-1]
            self.levels.append([self.add(last[i : i + 2]) for i in range(0, len(last), 2)])

    def sums(self, leaf: list[str]) -> tuple[int, int, int]:
        return sum(map(len, leaf)), len(leaf), sum(map(self.counts.__getitem__, leaf))

    @staticmethod
    def add(nodes: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        return nodes[0] if len(nodes) == 1 else tuple(a + b for a, b in zip(*nodes, strict=True))

    @property
    def total(self) -> tuple[int, int, int]:
        """Characters, pre-tokens, tokens."""
        return self.levels[-1][0]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end) and where the leaf begins."""
        node, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            while node + 1 < len(level) and at >= begin + level[node][0] and node % 2 == 0:
                begin += level[node][0]
                node += 1
        return node, begin

    def edit(self, pos: int, deleted: int, inserted: str) -> None:
        size = self.total[0]
        pos = min(max(pos, 0), size)
        stop = min(pos + max(deleted, 0), size)
        first, begin = self.find(max(0, pos - CONTEXT))
        kept, start = [], begin
        for piece in self.leaves[first]:
            if start + len(piece) > pos - CONTEXT:
                break
            kept.append(piece)
            start += len(piece)
        # old pieces up to the end of what goes
        last, old, cut, here = first, self.leaves[first][len(kept) :], [], start
        while here < stop:
            if not old:
                last += 1
                old = self.leaves[last]
                continue
            cut.append(old[0])
            here += len(old[0])
            old = old[1:]
        text = "".join(cut)
        buffer = text[: pos - start] + inserted + text[stop - start :]
        # old boundaries as places in the buffer: how many of ``old`` lie before each
        edge, marks, read = pos - start + len(inserted), {len(buffer): 0}, 0
        new, passed = [], 0
        while True:
            for piece in old[read:]:
                buffer += piece
                read += 1
                marks[len(buffer)] = read
            ended = last + 1 == len(self.leaves)
            for m in SPLIT.finditer(buffer, passed):
                if passed >= edge and passed in marks or m.end() + CONTEXT > len(buffer) and not ended:
                    break
                new.append(m[0])
                passed = m.end()
            if passed >= edge and passed in marks or ended:
                break
            last += 1
            old = old + self.leaves[last]
        self.encoded += len(new)
        self.replace(first, last, kept + new + old[marks.get(passed, read) :])

    def replace(self, first: int, last: int, leaf: list[str]) -> None:
        """Leaf ``first`` gets the pieces, the others up to ``last`` become empty; the sums above follow."""
        for k in range(first + 1, last + 1):
            self.leaves[k], self.levels[0][k] = [], (0, 0, 0)
        self.leaves[first], self.levels[0][first] = leaf, self.sums(leaf)
        if len(leaf) > 8 * LEAF:
            return self.grow([p for x in self.leaves for p in x])
        a, b = first, last
        for k in range(1, len(self.levels)):
            a, b = a // 2, b // 2
            for i in range(a, b + 1):
                self.levels[k][i] = self.add(self.levels[k - 1][2 * i : 2 * i + 2])
        return None

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def count_edits(docs: DataFrame, edits: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts before and after the edits (in order, positions in the text as it then is) of each row.

    doc_id, n_chars, n_pretokens, n_tokens; the same with _edited; n_encoded (pre-tokens that the edits encoded).
    """
    shipped = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shipped.value)
        for batch in slices(batches, "text"):
            out = []
            for doc, text, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Tree(text or "", counts)
                before = tree.total
                for e in changes or []:
                    if e is not None:
                        tree.edit(e["pos"] or 0, e["deleted"] or 0, e["inserted"] or "")
                out.append((doc, *before, *tree.total, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(8)], NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


STORED = "array<struct<text:string,sizes:array<int>,tokens:array<int>>>"
LEAVES = pa.list_(pa.struct([("text", pa.string()), ("sizes", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))
KEPT = f"doc_id long, n_chars long, n_pretokens long, n_tokens long, n_encoded long, leaves {STORED}"


def _table(shipped, batches: Iterable[pa.RecordBatch], column: str | None, make) -> Iterator[pa.RecordBatch]:
    """Rows as KEPT of the trees that ``make`` gives for a row."""
    counts = Counts(shipped.value)
    for batch in batches if column is None else slices(batches, column):
        out = []
        for doc, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree = make(counts, *row)
            out.append((doc, *tree.total, tree.encoded, tree.stored()))
        yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(5)), pa.array([r[5] for r in out], LEAVES)], ["doc_id", "n_chars", "n_pretokens", "n_tokens", "n_encoded", "leaves"])


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The tree of each row as a table to keep: doc_id, n_chars, n_pretokens, n_tokens, n_encoded (0) and the leaves."""
    shipped = ship(docs.sparkSession, vocabulary)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _table(shipped, batches, "text", lambda counts, text: Tree(text or "", counts)), KEPT)


def edit_trees(kept: DataFrame, edits: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """A table of :func:`trees` after the edits of each row; n_encoded is how many pre-tokens they encoded."""
    shipped = ship(kept.sparkSession, vocabulary)

    def change(counts: Counts, leaves: list[dict], changes: list[dict] | None) -> Tree:
        tree = Tree.kept(leaves, counts)
        for e in changes or []:
            if e is not None:
                tree.edit(e["pos"] or 0, e["deleted"] or 0, e["inserted"] or "")
        return tree

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = (batch.slice(k, 64) for batch in batches for k in range(0, batch.num_rows, 64))
        return _table(shipped, few, None, change)

    return kept.select("doc_id", "leaves", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, KEPT)


NAMES = ["doc_id", "n_chars", "n_pretokens", "n_tokens", "n_chars_edited", "n_pretokens_edited", "n_tokens_edited", "n_encoded"]


def query(spark, sf_dir: str) -> DataFrame:
    """Three edits of each document: words put in at a third, 40 characters out of the middle, 20 near the end turned round."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0))
    at = (n * 3 / 4).cast("int")
    edit = lambda pos, deleted, inserted: F.struct(pos.cast("int").alias("pos"), deleted.cast("int").alias("deleted"), inserted.alias("inserted"))
    edits = F.array(
        edit(at, F.lit(20), F.reverse(F.substring("text", at + 1, F.lit(20)))),
        edit(n / 2, F.lit(40), F.lit("")),
        edit(n / 3, F.lit(0), F.concat(F.lit(" edited in "), F.coalesce(F.col("source"), F.lit("")), F.lit(", twice; "))),
    )
    return count_edits(docs.withColumn("edits", edits))
