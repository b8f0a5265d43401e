"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator; ids are 64-bit, and this value is reserved.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A local session without ``spark.checkpoint.dir`` (a test) gets a temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="placeforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors.

    It goes when the application ends, or by :func:`discard` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/placeforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._placeforge_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_placeforge_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, most: int) -> DataFrame:
    """The table, written, and marked for broadcast only if it has at most ``most`` rows by count."""
    made = materialize(df)
    return F.broadcast(made) if made.limit(most + 1).count() <= most else made


def solid_id(name: str | Column = "doc_id") -> Column:
    """The id with NULL_ID for null, so that joins and sorts keep such rows."""
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("long"), F.lit(NULL_ID))


def text_key(name: str | Column = "text") -> Column:
    """Tells apart rows that share an id: a 64-bit hash of the text, never null."""
    return F.xxhash64(F.col(name) if isinstance(name, str) else name)


def plain_id(name: str) -> Column:
    """The inverse of :func:`solid_id`."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus, F.lit(0))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``most`` bytes in each: long texts don't pile up."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def map_rows(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow; ``make`` takes and gives an iterator of record batches."""
    return df.mapInArrow(make, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
