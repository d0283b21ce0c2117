"""Tumbling bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailward.functions.order import time_order
from tailward.functions.time import WIDTH, with_bar


def to_bars(
    df: DataFrame, key: str, ts: str, px: str, volume: str, row_id: str, width: str = WIDTH
) -> DataFrame:
    """First, highest, lowest and last price, summed volume and row count per key and bar.

    Rows of equal time are ordered by ``row_id``, a bigint. All aggregates combine before the
    shuffle, in a hash table of the task's bars: no task sorts its rows.
    """
    at = F.col("_at")
    return (
        with_bar(df, ts, width)
        .withColumn("_at", time_order(ts, F.col("bar"), row_id))
        .groupBy(key, "bar")
        .agg(
            F.min_by(px, at).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, at).alias("close"),
            F.sum(volume).alias("volume"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
