"""Token ids packed into rows of one length by best fit decreasing.

Texts are encoded and each is ended by the vocabulary's free id.  What is longer than a row is split
into pieces without loss.  Pieces of one chunk of a partition (CHUNK ids at most beyond one document)
are packed longest first, each into the fullest row that still takes it; a segment tree over free
capacities finds that row.  No shuffle is needed, and a task holds one chunk.

A row has its ids and positions as little-endian binary (``bits`` wide; positions start at 0 in every
segment), the cumulative segment lengths, and for each segment the document and where in it the
segment begins.  Room at the end is filled with the end id and belongs to no segment.
A null or empty text is a segment of the end id alone.  Rows are independent: a null or repeated id gives
segments of its own for each row; other columns don't matter; an empty table gives no row.  Pieces of
equal length are packed in the order of the input, into the row opened last among equally full ones.  A
very long text is encoded as a whole by one task, and its pieces make a chunk of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .tokenizer import VOCABULARY, Encoder, ship

LENGTH = 2048
CHUNK = 3_000_000
SCHEMA = "part int, chunk int, row int, bits int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<int>"


class Capacities:
    """Open rows by free capacity; a segment tree finds the least capacity that suffices."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self.change(free, 1)

    def change(self, free: int, by: int) -> None:
        i = self.base + free
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its free capacity) of the best fit, removed; None if no row has room."""
        i = self.base + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.base
        self.change(free, -1)
        return self.rows[free].pop(), free


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers; longest first, equal ones in order."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = open_rows.take(sizes[k])
        if found is None:
            found = len(rows), length
            rows.append([])
        row, free = found
        rows[row].append(k)
        if free > sizes[k]:
            open_rows.put(free - sizes[k], row)
    return rows


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows; columns as SCHEMA."""
    shipped = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        kind, end = encoder.type, encoder.plain.n_vocab
        width, part = kind.itemsize, TaskContext.get().partitionId()
        last = np.array([end], kind).tobytes()
        places = np.arange(length, dtype=kind)
        pieces: list[tuple[int | None, int, bytes]] = []
        held = chunk = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held
            sizes = [len(p[2]) // width for p in pieces]
            out: list[tuple] = []
            for r, row in enumerate(best_fit(sizes, length)):
                ends = np.concatenate(([0], np.cumsum([sizes[k] for k in row])))
                n = int(ends[-1])
                ids = b"".join([pieces[k][2] for k in row]) + last * (length - n)
                positions = np.concatenate([places[: sizes[k]] for k in row] + [places[: length - n]])
                out.append((part, chunk, r, 8 * width, n, ids, positions.tobytes(), ends.tolist(), [pieces[k][0] for k in row], [pieces[k][1] for k in row]))
            for i in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out[i : i + 512]], t) for k, t in enumerate(TYPES)], NAMES)
            pieces.clear()
            held, chunk = 0, chunk + 1

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encoder.ids(text) if text else b"") + last
                for at in range(0, len(ids), length * width):
                    pieces.append((doc, at // width, ids[at : at + length * width]))
                held += len(ids) // width
                if held >= CHUNK:
                    yield from packed()
        if pieces:
            yield from packed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [*[pa.int32()] * 5, pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
