"""Option-shaped inputs derived from the driver's tables (synthetic: no financial meaning)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _k() -> F.Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def _variety() -> F.Column:
    return (F.col("user_id") % 6).cast("int").alias("variety")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one snapshot of 7 strikes, 2 tenors, call and put."""
    legs = F.array(
        *[
            F.struct(F.lit(i).alias("m"), F.lit(tenor).alias("tenor_days"), F.lit(p).alias("p"))
            for i in range(-3, 4)
            for tenor in (30, 90)
            for p in (0, 1)
        ]
    )
    snaps = _events(spark, sf_dir).select("event_id", "ts", "user_id", "value", "props").repartition("event_id").select(
        "event_id", "ts", _variety(), (F.lit(100.0) + F.col("value") / 10).alias("fwd"), _k().alias("k")
    )
    m, p, tenor, eid = F.col("m"), F.col("p"), F.col("tenor_days"), F.col("event_id")
    far = tenor == 90
    return snaps.select("*", F.inline(legs)).select(
        (eid * 28 + (m + 3) * 4 + F.when(far, 2).otherwise(0) + p).alias("quote_id"),
        "ts",
        "variety",
        "fwd",
        "tenor_days",
        F.when(p == 0, "C").otherwise("P").alias("cp"),
        m.alias("mny_idx"),
        (F.col("fwd") * (F.lit(1.0) + m.cast("double") / 20)).alias("strike"),
        (
            F.lit(0.2)
            + F.col("k").cast("double") / 1000
            - m.cast("double") / 200
            + (m * m).cast("double") / 1000
            + F.when(far, F.lit(0.01)).otherwise(F.lit(0.0))
            + p.cast("double") / 500
        ).alias("iv"),
        (1 + (eid * 31 + (m + 3) * 17 + tenor + p * 41) % 97).alias("volume"),
        (100 + (eid * 7 + (m + 3) * 13 + tenor + p * 59) % 997).alias("open_interest"),
        (1 + (eid * 5 + m + 3) % 50).alias("bid_size"),
        (1 + (eid * 3 + (m + 3) * 7 + p * 11) % 50).alias("ask_size"),
        ((eid * 11 + (m + 3) * 5 + p * 2 + tenor) % 3 - 1).cast("int").alias("side"),
    )


def uneven_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, each a snapshot of 7 strikes and 2 tenors that differ from event to event.

    Events of every third half hour are moved to the next one, so that bars are missing. Volatility
    bends by event over moneyness and tenor; some are unknown, and some strikes are zero.
    """
    legs = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(t).alias("t"), F.lit(p).alias("p")) for i in range(-3, 4) for t in (0, 1) for p in (0, 1)])
    moved = F.when((F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)) % 3 == 0, F.col("ts") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("ts"))
    events = _events(spark, sf_dir).select("event_id", moved.alias("ts"), "user_id", "value", "props")
    snaps = events.repartition("event_id").select("event_id", "ts", _variety(), (F.lit(100.0) + F.col("value") / 10).alias("fwd"), _k().alias("k"))
    m, p, t, eid, k = F.col("m"), F.col("p"), F.col("t"), F.col("event_id"), F.col("k")
    tenor = F.when(t == 0, 20 + eid % 3 * 7).otherwise(85 + eid % 4 * 6).cast("int")
    smile = (
        F.lit(0.2)
        + k.cast("double") / 1000
        - (m * (1 + k % 7)).cast("double") / 300
        + (m * m * (1 + k % 5)).cast("double") / 900
        + (t * (k % 11 - 5)).cast("double") / 400
        + (p * (k % 3)).cast("double") / 500
    )
    return snaps.select("*", F.inline(legs)).select(
        (eid * 28 + (m + 3) * 4 + t * 2 + p).alias("quote_id"),
        "ts",
        "variety",
        "fwd",
        tenor.alias("tenor_days"),
        F.when(p == 0, "C").otherwise("P").alias("cp"),
        m.alias("mny_idx"),
        F.when((eid % 101 == 0) & (m == -3), F.lit(0.0)).otherwise(F.col("fwd") * (F.lit(1.0) + m.cast("double") / 20)).alias("strike"),
        F.when(~((eid % 17 == 0) & (m == 2)), smile).alias("iv"),
        (1 + (eid * 31 + (m + 3) * 17 + t + p * 41) % 97).alias("volume"),
        (100 + (eid * 7 + (m + 3) * 13 + t + p * 59) % 997).alias("open_interest"),
        (1 + (eid * 5 + m + 3) % 50).alias("bid_size"),
        (1 + (eid * 3 + (m + 3) * 7 + p * 11) % 50).alias("ask_size"),
        F.when(eid % 13 == 0, 1).otherwise((eid * 11 + (m + 3) * 5 + p * 2 + t) % 3 - 1).cast("int").alias("side"),
    )


def exo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .where((F.col("event_type") == "error") & (F.col("value") >= 100))
        .select(
            F.col("event_id").alias("src_id"),
            _variety(),
            F.col("ts").alias("start_ts"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"),
            F.when(_k() < 20, "named").otherwise("market").alias("source"),
        )
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") == "signup")
        .groupBy(F.to_date("ts").alias("obs_date"))
        .agg(F.round(F.avg("value"), 6).alias("macro_index"))
    )


def week(spark: SparkSession) -> DataFrame:
    """A weekly plan of sessions: mornings and afternoons on weekdays, and nights that run past midnight for even varieties."""
    day = [(v, d, a, b) for v in range(6) for d in range(1, 6) for a, b in ((9 * 60, 11 * 60 + 30), (13 * 60 + 30, 15 * 60))]
    night = [(v, d, 21 * 60, 25 * 60) for v in (0, 2, 4) for d in range(1, 6)]
    return spark.createDataFrame(day + night, "variety int, weekday int, open_minute int, close_minute int")
