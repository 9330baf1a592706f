"""The same operators on streams: they keep no state, so they apply to a streaming DataFrame as they are.

What adds state is counting: valid and failing rows by window, with a watermark for late rows.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.validator import validate


def split_stream(df: DataFrame, column: str, schema: Any, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(rows that hold, rows that don't with their errors). Both read the source; give each its own sink."""
    checked = validate(df, column, schema, "__checked", mode)
    return checked.where("__checked.is_valid").drop("__checked"), checked.where("NOT __checked.is_valid").withColumn("errors", F.col("__checked.errors")).drop("__checked")


def validity_rate(df: DataFrame, column: str, schema: Any, time: str, window: str = "5 minutes", late: str = "10 minutes", by: tuple[str, ...] = (), mode: str = "auto") -> DataFrame:
    """Rows and valid rows for each window of `time`; rows later than `late` are dropped by the watermark."""
    checked = validate(df.withWatermark(time, late) if df.isStreaming else df, column, schema, "__checked", mode)
    grouped = checked.groupBy(F.window(time, window), *by).agg(F.count("*").alias("n_rows"), F.count_if("__checked.is_valid").alias("n_valid"))
    return grouped.select(F.col("window.start").alias("window_start"), *by, "n_rows", "n_valid")
