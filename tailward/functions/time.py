"""Time grid helpers. All of them work on ``timestamp_ntz`` and add no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = "15 minutes"


def with_bar(df: DataFrame, ts: str = "ts", width: str = WIDTH, name: str = "bar") -> DataFrame:
    """Add the start of the tumbling window that holds ``ts``; rows without a time drop out."""
    return df.withColumn(name, F.window(F.col(ts), width)["start"])


def interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def shift(ts: Column, by: str, sign: int = 1) -> Column:
    return ts + interval(by) if sign > 0 else ts - interval(by)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Elapsed minutes as a double."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(60e6)
