"""Exact quantiles of tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailward.session import stage


def weighted_quantiles(counts: DataFrame, by: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group from a (group, value, count) table.

    ``percentile`` keeps every distinct value of a group in one task. Here the
    counted values are range-partitioned instead, so a group spreads over as many
    partitions as it needs; partition totals tell which partition holds a wanted
    rank, and only those partitions are ordered. ``by`` must have few distinct
    values (columns of a profile, varieties). Result: ``by`` + ``q`` + ``quantile``.
    """
    return ranged_quantiles(range_counts(counts, by, value, weight), by, value, weight, qs)


def range_counts(counts: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The counted values written in range partitions, each row with the number of its partition."""
    ordered = counts.select(*by, value, weight).repartitionByRange(*by, value)
    return stage(ordered.withColumn("_part", F.spark_partition_id()), "ranged")


def ranged_quantiles(table: DataFrame, by: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """Quantiles from a table made by ``range_counts``; null values do not count."""
    known = F.col(value).isNotNull()
    ranged = table.where(known).select(*by, "_part", F.col(value).alias("_v"), F.col(weight).alias("_n"))
    # One row per group and partition: never more rows than shuffle partitions per group.
    in_order = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranks = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    parts = (
        ranged.groupBy(*by, "_part")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(in_order), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(whole))
        .select("*", ranks)
        .withColumn("_pos", F.col("q") * (F.col("_total") - 1))
        .where((F.ceil("_pos") >= F.col("_before")) & (F.floor("_pos") < F.col("_before") + F.col("_size")))
    )
    # ``parts`` has at most two rows per group and quantile, and ``by`` is a handful of groups.
    inside = Window.partitionBy(*by, "_part", "q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.join(F.broadcast(parts), [*by, "_part"])
        .withColumn("_to", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )

    def at(rank):
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))

    return (
        placed.groupBy(*by, "q")
        .agg(at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"), F.first("_pos").alias("_pos"))
        .select(*by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias("quantile"))
    )
