"""The step for a trained normaliser after the rules; without a model names stay as the rules leave them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that a model gets at once.
BATCH = 64


def refine(rows: DataFrame, columns: list[str], load: Callable[[], Callable], batch: int = BATCH) -> DataFrame:
    """``rows`` with what the model makes of the names in ``columns``.

    ``load`` runs once in a Python worker and returns a function from an array of names to an array of
    names.  The model sees each distinct name once; null and empty names aren't shown to it, and an
    empty answer leaves a name as it is.
    """
    names = rows.select(F.explode(F.array(*columns)).alias("given")).filter("given <> ''").distinct()
    model = predict_batch_udf(load, return_type=StringType(), batch_size=batch)
    answers = names.withColumn("answer", model("given")).filter("answer <> '' AND answer <> given")
    for c in columns:
        rows = rows.join(answers, F.col(c) == F.col("given"), "left").withColumn(c, F.coalesce("answer", c)).drop("given", "answer")
    return rows
