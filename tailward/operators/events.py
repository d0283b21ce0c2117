"""Event intervals: fusing sources, labelling bars, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.time import interval, with_bar
from tailward.session import stage


def _merge(df: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping or touching intervals inside each ``by`` group."""
    w = Window.partitionBy(*by).orderBy("start_ts", "end_ts")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end_ts").over(before)
    head = F.when(reach.isNull() | (F.col("start_ts") > reach), F.col("start_ts"))
    return (
        df.withColumn("_head", head)
        .withColumn("_head", F.max("_head").over(so_far))
        .groupBy(*by, F.col("_head").alias("_start"))
        .agg(*_totals())
        .withColumnRenamed("_start", "start_ts")
    )


def _totals() -> list:
    return [
        F.max("end_ts").alias("end_ts"),
        F.sum("n_events").alias("n_events"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    ]


def fuse_events(*tables: DataFrame, key: str = "variety", chunk: str = "1 hour", salts: int = 16) -> DataFrame:
    """Union event sources and merge overlapping intervals per key, with count and sorted set of sources.

    Merging is associative, so no key is ever ordered in one task: copies collapse
    first, then intervals merge inside (key, chunk, salt), then inside (key, chunk),
    and only the furthest end of each chunk is carried over to later chunks.
    """
    union = reduce(lambda a, b: a.unionByName(b), [t.select(key, "start_ts", "end_ts", "source") for t in tables])
    once = union.groupBy(key, "start_ts", "end_ts", "source").agg(F.count(F.lit(1)).alias("n_events"))
    chunked = (
        with_bar(once, "start_ts", chunk, "_chunk")
        .withColumn("_salt", F.pmod(F.xxhash64("start_ts", "end_ts"), F.lit(salts)))
        .select(key, "_chunk", "_salt", "start_ts", "end_ts", "n_events", F.array("source").alias("sources"))
    )
    local = stage(_merge(_merge(chunked, [key, "_chunk", "_salt"]), [key, "_chunk"]), "islands")

    # One row per key and chunk: the calendar bounds the windows below.
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        local.groupBy(key, "_chunk")
        .agg(F.max("end_ts").alias("_end"), F.max("start_ts").alias("_last"))
        .withColumn("_reach", F.max("_end").over(earlier))
        .withColumn("_own", F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last")))
        .withColumn("_open", F.max("_own").over(earlier))
        .select(key, "_chunk", "_reach", "_open")
    )
    absorbed = F.col("start_ts") <= F.col("_reach")
    return (
        local.join(chunks, [key, "_chunk"])
        .withColumn("_start", F.when(absorbed, F.col("_open")).otherwise(F.col("start_ts")))
        .groupBy(key, "_start")
        .agg(*_totals())
        .withColumnRenamed("_start", "start_ts")
    )


def label_bars(bars: DataFrame, events: DataFrame, horizon: str = "4 hours", slot: str = "15 minutes", key: str = "variety") -> DataFrame:
    """Add ``label``: 1 when an event of the key starts in ``(bar, bar + horizon]``.

    Events first collapse to the earliest and latest start per slot. Any start in a slot
    strictly between those of the bar and of the horizon's end counts; in the slot of
    the bar the latest start decides, in the slot of the end the earliest. ``horizon``
    must be at least one slot long.
    """
    slots = with_bar(events, "start_ts", slot, "_slot").groupBy(key, "_slot").agg(
        F.min("start_ts").alias("_first"), F.max("start_ts").alias("_latest")
    )
    bar, end = F.col("bar"), F.col("bar") + interval(horizon)
    reach = bars.select(key, "bar").distinct()
    asked = (
        reach.withColumn("_lo", F.window("bar", slot)["start"])
        .withColumn("_end", end)
        .withColumn("_hi", F.window("_end", slot)["start"])
        .select(key, "bar", F.explode(F.sequence("_lo", "_hi", interval(slot))).alias("_slot"))
    )
    hit = ((F.col("_first") > bar) & (F.col("_first") <= end)) | ((F.col("_latest") > bar) & (F.col("_latest") <= end))
    flagged = asked.join(slots, [key, "_slot"]).where(hit).select(key, "bar").distinct().withColumn("_hit", F.lit(1))
    return bars.join(flagged, [key, "bar"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def event_coverage(events: DataFrame, keys: DataFrame, sources: list[str], key: str = "variety") -> DataFrame:
    """Events per source and key with zero cells shown; ``keys`` and ``sources`` name those that must appear, others appear if they have events."""
    cells = keys.select(key).distinct().select(key, F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    counts = events.groupBy(key, "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_ts").alias("first_start"), F.max("start_ts").alias("last_start")
    )
    return cells.join(counts, [key, "source"], "full_outer").withColumn("n_events", F.coalesce("n", F.lit(0))).drop("n")
