"""Tables behind a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_heatmap(levels: DataFrame) -> DataFrame:
    """Peak level per day and variety, one cell a row, whatever varieties there are."""
    return levels.groupBy(F.to_date("bar").alias("day"), "variety").agg(F.max("level").alias("peak_level"))


def latest_status(levels: DataFrame) -> DataFrame:
    """Last bar and its level per variety."""
    last = levels.groupBy("variety").agg(F.max_by(F.struct("bar", "level"), "bar").alias("last"))
    return last.select("variety", F.col("last.bar").alias("bar"), F.col("last.level").alias("level"))


def top_warnings(episodes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` strongest episodes: peak level, then length, then the earliest, then the variety."""
    return episodes.orderBy(F.desc("peak_level"), F.desc("n_bars"), "start_bar", "variety").limit(k)


def level_counts(levels: DataFrame) -> DataFrame:
    """Bars by variety and level, with subtotals; ``grouping_level`` is 0 for a cell, 1 and 3 for totals."""
    return levels.rollup("variety", "level").agg(
        F.count(F.lit(1)).alias("n_bars"), F.grouping_id().cast("int").alias("grouping_level")
    )
