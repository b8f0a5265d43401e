"""Stateless extraction and windowed keep-first over streams of elements that carry coordinates.

The batch engine is the main one; these serve incremental feeds of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.extract import candidates


def stream_objects(nodes: DataFrame) -> DataFrame:
    """Candidates with broken characters replaced; ``nodes`` has lat and lon already."""
    rows = candidates(nodes.withColumn("kind", F.lit("node")))
    for c in ("city", "street", "name"):
        rows = rows.withColumn(c, text.normalize_chars(F.col(c)))
    return rows


def keep_first(rows: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """One row for each key within the watermark's delay."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
