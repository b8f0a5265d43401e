"""A Spark data source for map extracts in the public PBF format.

A file is a run of blobs; the driver reads only their heads, and each task decodes a range of blobs.
seq is the blob's number * 2^32 + the element's number within it, so the file's order is kept.  Of
repeated tag keys the last wins.  The path must be readable by driver and executors alike.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.extract import ELEMENTS


def varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, i
        shift += 7


def signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers, or bytes of what has a length."""
    i = 0
    while i < len(b):
        key, i = varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = varint(b, i)
        elif kind == 2:
            n, i = varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = int.from_bytes(b[i : i + n], "little"), i + n
        yield key >> 3, value


def packed(b: bytes, sign: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        n, i = varint(b, i)
        out.append(signed(n) if sign else n)
    return out


def running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def message(b: bytes) -> dict[int, int | bytes]:
    return dict(fields(b))


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, offset, length) of each blob."""
    with open(path, "rb") as f:
        while head := f.read(4):
            about = message(f.read(struct.unpack(">I", head)[0]))
            size = about[3]
            yield about[1].decode(), f.tell(), size
            f.seek(size, 1)


def inflate(blob: bytes) -> bytes:
    got = message(blob)
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    if 7 in got:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(got[7], max_output_size=got.get(2, 0))
    raise ValueError("unknown blob compression")


def decode(block: bytes, seq: int) -> Iterator[tuple]:
    """Rows of ELEMENTS of one block."""
    strings: list[str] = []
    groups: list[bytes] = []
    scale = {17: 100, 19: 0, 20: 0}
    for number, value in fields(block):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, v in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number in scale:
            scale[number] = value - (1 << 64) if value >> 63 else value
    lat_of = lambda v: 1e-9 * (scale[19] + scale[17] * v)
    lon_of = lambda v: 1e-9 * (scale[20] + scale[17] * v)
    tags_of = lambda m: {strings[k]: strings[v] for k, v in zip(packed(m.get(2, b"")), packed(m.get(3, b"")), strict=True)}
    kinds = {0: "node", 1: "way", 2: "relation"}
    for group in groups:
        for number, value in fields(group):
            if number == 1:
                m = message(value)
                yield seq, "node", signed(m[1]), lat_of(signed(m[8])), lon_of(signed(m[9])), tags_of(m), None, None
                seq += 1
            elif number == 2:
                m = message(value)
                ids, lats, lons = (running(packed(m.get(k, b""), True)) for k in (1, 8, 9))
                pairs, at = packed(m.get(10, b"")), 0
                for one, lat, lon in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while at < len(pairs) and pairs[at]:
                        tags[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield seq, "node", one, lat_of(lat), lon_of(lon), tags, None, None
                    seq += 1
            elif number == 3:
                m = message(value)
                yield seq, "way", m[1], None, None, tags_of(m), running(packed(m.get(8, b""), True)), None
                seq += 1
            elif number == 4:
                m = message(value)
                roles, refs, types = packed(m.get(8, b"")), running(packed(m.get(9, b""), True)), packed(m.get(10, b""))
                yield seq, "relation", m[1], None, None, tags_of(m), None, [(kinds[t], r, strings[role]) for t, r, role in zip(types, refs, roles, strict=True)]
                seq += 1


class Blobs(InputPartition):
    def __init__(self, path: str, which: list[tuple[int, int, int]]):
        super().__init__(None)
        self.path, self.which = path, which


class Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[Blobs]:
        data = [(k, at, size) for k, (kind, at, size) in enumerate(blobs(self.path)) if kind == "OSMData"]
        return [Blobs(self.path, data[i : i + self.per_task]) for i in range(0, len(data), self.per_task)] or [Blobs(self.path, [])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for k, at, size in partition.which:
                f.seek(at)
                yield from decode(inflate(f.read(size)), k << 32)


class PbfSource(DataSource):
    """``spark.dataSource.register(PbfSource)``, then ``spark.read.format("osmpbf").load(path)``; option blobsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self):
        return ELEMENTS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("blobsPerTask", "8")))


def read(spark, path: str):
    spark.dataSource.register(PbfSource)
    return spark.read.format("osmpbf").load(path)
