"""Profiling and quality checks of raw and derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.quantile import range_counts, ranged_quantiles
from tailward.functions.time import WIDTH, interval, with_bar
from tailward.session import stage


def profile(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """One row per numeric column: count, nulls, distinct, min, max, mean, p50.

    The exact form counts each (column, value) once, with map-side combination, and
    takes every figure from those counts, so the input is scanned and shuffled once.
    ``approx`` replaces distinct and p50 by sketches in a single aggregation.
    """
    if approx:
        return _profile_sketch(df, cols)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    counts = range_counts(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), ["column"], "value", "n")
    known = F.col("value").isNotNull()
    stats = counts.groupBy("column").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_values"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(F.when(known, F.col("n")))).alias("mean_value"),
    )
    p50 = ranged_quantiles(counts, ["column"], "value", "n", [0.5]).select("column", F.col("quantile").alias("p50"))
    return stats.join(p50, "column", "left")


def count_ids(df: DataFrame, by: list[str], row_id: str, **figures: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """Per group the exact number of distinct ids (bigints) in ``n_distinct``, and ``figures``: each an aggregate and the one that adds it up.

    64 neighbouring ids share a row, whose bits tell which of them occur, so where ids are dense
    a small part of the rows is moved; where they are not, one row per id, like any distinct count.
    """
    word, bit = F.shiftright(row_id, 6), F.col(row_id).bitwiseAND(F.lit(63)).cast("int")
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    words = df.groupBy(*by, word.alias("_word")).agg(mask.alias("_mask"), *[first.alias(c) for c, (first, _) in figures.items()])
    n = F.coalesce(F.sum(F.bit_count("_mask")), F.lit(0))
    return words.groupBy(*by).agg(n.alias("n_distinct"), *[add(c).alias(c) for c, (_, add) in figures.items()])


def _profile_sketch(df: DataFrame, cols: list[str]) -> DataFrame:
    def figures(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(v).alias("n_values"),
            F.count_if(v.isNull()).alias("n_null"),
            F.approx_count_distinct(v).alias("n_distinct"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
            F.avg(v).alias("mean_value"),
            F.percentile_approx(v, 0.5).alias("p50"),
        )

    return df.agg(F.array(*[figures(c) for c in cols]).alias("rows")).select(F.inline("rows"))


def _bars_present(df: DataFrame, key: str, ts: str, width: str) -> DataFrame:
    return stage(with_bar(df, ts, width).select(key, "bar").distinct(), "present")


def _grid(present: DataFrame, key: str, width: str) -> DataFrame:
    """All bars of every day from the first to the last day of each key."""
    days = present.groupBy(key).agg(F.min(F.to_date("bar")).alias("lo"), F.max(F.to_date("bar")).alias("hi"))
    steps = F.sequence(F.col("lo").cast("timestamp_ntz"), F.date_add("hi", 1).cast("timestamp_ntz"), interval(width))
    grid = days.select(key, "hi", F.explode(steps).alias("bar")).where(F.to_date("bar") <= F.col("hi"))
    return grid.select(key, F.to_date("bar").alias("day"), "bar")


def missing_bars(df: DataFrame, key: str, ts: str, width: str = WIDTH) -> DataFrame:
    """Bars of the full grid without any row."""
    present = _bars_present(df, key, ts, width)
    return _grid(present, key, width).join(present, [key, "bar"], "left_anti").select(key, "day", "bar")


def coverage(df: DataFrame, key: str, ts: str, width: str = WIDTH) -> DataFrame:
    """Present and missing bars per key and day.

    The raw table is read once and reduced to distinct bars; the grid and the join
    only see those, and their number depends on the calendar and not on the data.
    """
    present = _bars_present(df, key, ts, width)
    return (
        _grid(present, key, width)
        .join(present.withColumn("seen", F.lit(1)), [key, "bar"], "left")
        .groupBy(key, "day")
        .agg(F.count("seen").alias("n_present"), F.count_if(F.col("seen").isNull()).alias("n_missing"))
    )


def align_quality(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], tol: float) -> DataFrame:
    """Compare two feature tables, one row per column.

    Rows on both sides, on the left only and on the right only; among matched rows
    the values compared (both known), within ``tol``, and the largest difference.
    """
    side = lambda df, tag: df.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in cols], F.lit(1).alias(f"_{tag}"))
    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    diff = lambda c: F.when(matched, F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")))
    totals = both.agg(
        F.count_if(matched).alias("n_matched"),
        F.count_if(F.col("_r").isNull()).alias("n_left_only"),
        F.count_if(F.col("_l").isNull()).alias("n_right_only"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(diff(c)).alias("n_compared"),
                    F.count_if(diff(c) <= F.lit(tol)).alias("n_within"),
                    F.max(diff(c)).alias("max_abs_diff"),
                )
                for c in cols
            ]
        ).alias("per_column"),
    )
    return totals.select(F.inline("per_column"), "n_matched", "n_left_only", "n_right_only")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per row and broken rule, the rule's name in ``rule``.

    Unfolding the rules instead of filtering on them keeps the predicates out of the
    projections below: a filter would be pushed through them, and evaluate a computed
    column such as a price once more for every mention of it.
    """
    names = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return df.select("*", F.explode(names).alias("rule")).where(F.col("rule").isNotNull())


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, in one pass; the row ``(clean)`` counts rows that break none."""
    cells = [F.struct(F.lit(n).alias("rule"), F.count_if(r).alias("n_rows")) for n, r in rules.items()]
    cells.append(F.struct(F.lit("(clean)").alias("rule"), F.count_if(_passes(rules)).alias("n_rows")))
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def clean(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break no rule; a rule that is null for a row does not count as broken."""
    return df.where(_passes(rules))


def _passes(rules: dict[str, Column]) -> Column:
    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & ~F.coalesce(rule, F.lit(False))
    return ok


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Violating rows, per-rule counts and the clean subset."""
    return violations(df, rules), rule_counts(df, rules), clean(df, rules)


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first record per key in ``order`` (descending time, then an id that breaks ties).

    Spark applies the rank limit before the shuffle as well (``WindowGroupLimit``), so
    a key with very many copies sends one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")
