"""Trading sessions: open bars and their ordinals, so that closed hours are neither missing nor a gap.

Sessions are a table ``key, open_ts, close_ts``; a bar is open if it starts in one. All
tables here are bounded by the calendar, one row per key and open bar, and never by the
number of quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.time import WIDTH, interval, with_bar
from tailward.session import stage


def weekly_sessions(days: DataFrame, week: DataFrame, key: str = "variety") -> DataFrame:
    """The sessions of each of ``days`` (key, day) by a weekly plan (key, weekday 1 Monday to 7 Sunday, open_minute, close_minute).

    Minutes count from the day's midnight; a close past 1440 lies on the next day, which is
    how a night session is written. Days without a row in the plan are closed.
    """
    minute = lambda c: F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col(c))
    dated = days.select(key, "day").distinct().withColumn("weekday", F.weekday("day") + 1)
    return dated.join(week, [key, "weekday"]).select(key, minute("open_minute").alias("open_ts"), minute("close_minute").alias("close_ts"))


def open_bars(sessions: DataFrame, width: str = WIDTH, key: str = "variety") -> DataFrame:
    """(key, bar, ordinal) of every bar that starts in a session; ordinals count on without a break over closed hours.

    A session that begins within a bar has that bar too. Overlapping sessions do not repeat a bar.
    """
    starts = with_bar(sessions.where("open_ts < close_ts"), "open_ts", width, "_first")
    bars = starts.select(key, "close_ts", F.explode(F.sequence("_first", "close_ts", interval(width))).alias("bar")).where("bar < close_ts")
    in_time = Window.partitionBy(key).orderBy("bar")
    return stage(bars.select(key, "bar").distinct().withColumn("ordinal", F.row_number().over(in_time) - 1), "open-bars")


def session_coverage(df: DataFrame, calendar: DataFrame, ts: str = "ts", key: str = "variety", width: str = WIDTH) -> DataFrame:
    """Present and missing open bars per key and day, and bars with rows while closed.

    ``calendar`` is a table of ``open_bars``. The raw table is read once and reduced to distinct bars.
    """
    seen = with_bar(df, ts, width).select(key, "bar").distinct().withColumn("_seen", F.lit(True))
    both = calendar.select(key, "bar", F.lit(True).alias("_open")).join(seen, [key, "bar"], "full_outer")
    is_open, has = F.col("_open").isNotNull(), F.col("_seen").isNotNull()
    return both.groupBy(key, F.to_date("bar").alias("day")).agg(
        F.count_if(is_open & has).alias("n_present"), F.count_if(is_open & ~has).alias("n_missing"), F.count_if(~is_open).alias("n_outside")
    )


def missing_open_bars(df: DataFrame, calendar: DataFrame, ts: str = "ts", key: str = "variety", width: str = WIDTH) -> DataFrame:
    """Open bars without any row."""
    seen = with_bar(df, ts, width).select(key, "bar").distinct()
    return calendar.select(key, "bar").join(seen, [key, "bar"], "left_anti").select(key, F.to_date("bar").alias("day"), "bar")


def session_episodes(df: DataFrame, calendar: DataFrame, min_level: int = 1, gap_bars: int = 2, level: str = "level", key: str = "variety") -> DataFrame:
    """Runs of open bars at ``min_level`` or above, split where they are more than ``gap_bars`` open bars apart.

    A run goes on over a lunch break or a night; bars outside the sessions take no part.
    """
    in_time = Window.partitionBy(key).orderBy("ordinal")
    previous = F.lag("ordinal").over(in_time)
    first = previous.isNull() | (F.col("ordinal") > previous + gap_bars)
    return (
        df.where(F.col(level) >= min_level)
        .join(calendar, [key, "bar"])
        .withColumn("_first", F.when(first, F.col("bar")))
        .withColumn("start_bar", F.max("_first").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "start_bar")
        .agg(F.max("bar").alias("end_bar"), F.count(F.lit(1)).alias("n_bars"), F.max(level).alias("peak_level"))
    )


def _after(keys: DataFrame, calendar: DataFrame, at: str, key: str) -> DataFrame:
    """Distinct (key, ``at``) with ``ordinal``: of the open bar that holds the time, or else of the next one."""
    times = keys.select(key, at).distinct()
    asked = with_bar(times, at).select(key, F.col("bar").alias("_when"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_ordinal"), at)
    bars = calendar.select(key, F.col("bar").alias("_when"), F.lit(0).alias("_side"), F.col("ordinal").alias("_ordinal"), F.lit(None).cast("timestamp_ntz").alias(at))
    # An open bar comes before the times in it: a time takes its own bar, else the one after the last before it.
    whole = Window.partitionBy(key).orderBy("_when", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by(F.struct("_when", "_ordinal"), F.when(F.col("_side") == 0, F.col("_ordinal"))).over(whole)
    placed = asked.unionByName(bars).withColumn("_last", F.when(F.count("_ordinal").over(whole) > 0, last)).where("_side = 1")
    ordinal = F.when(F.col("_last").isNull(), 0).when(F.col("_last._when") == F.col("_when"), F.col("_last._ordinal")).otherwise(F.col("_last._ordinal") + 1)
    return placed.select(key, at, ordinal.alias("ordinal"))


def session_labels(bars: DataFrame, events: DataFrame, calendar: DataFrame, horizon_bars: int = 16, key: str = "variety") -> DataFrame:
    """Add ``label``: 1 when an event of the key starts after an open bar's start and no later than the start of the bar ``horizon_bars`` open bars on.

    An event in closed hours falls into the next open bar. A horizon beyond the calendar ends
    with it. Rows outside the sessions have a null label. Only the earliest and latest
    start of each open bar are compared, so a burst of events costs no more than two.
    """
    slots = events.join(_after(events, calendar, "start_ts", key), [key, "start_ts"]).groupBy(key, F.col("ordinal").alias("_slot")).agg(
        F.min("start_ts").alias("_first"), F.max("start_ts").alias("_latest")
    )
    ends = calendar.select(key, F.col("ordinal").alias("_to"), F.col("bar").alias("_end"))
    placed = bars.select(key, "bar").distinct().join(calendar, [key, "bar"]).withColumn("_to", F.col("ordinal") + horizon_bars).join(ends, [key, "_to"], "left")
    asked = placed.select(key, "bar", "_end", F.explode(F.sequence(F.col("ordinal"), F.col("_to"))).alias("_slot"))
    within = lambda c: (F.col(c) > F.col("bar")) & (F.col("_end").isNull() | (F.col(c) <= F.col("_end")))
    hit = asked.join(slots, [key, "_slot"]).where(within("_first") | within("_latest")).select(key, "bar").distinct().withColumn("_hit", F.lit(1))
    known = placed.select(key, "bar", F.lit(0).alias("_open"))
    return bars.join(known, [key, "bar"], "left").join(hit, [key, "bar"], "left").withColumn("label", F.coalesce("_hit", "_open")).drop("_hit", "_open")
