"""At-the-money Greeks and open-interest concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.order import id_order
from tailward.functions.time import WIDTH, with_bar
from tailward.operators.pricing import greeks
from tailward.operators.profiling import dedup_latest
from tailward.session import stage

KEY = ["variety", "bar"]
ATM_GROUP = [*KEY, "tenor_days", "cp"]
FIELDS = ["fwd", "strike", "tenor_days", "iv"]


def select_atm(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Per variety, bar, tenor and side the quote nearest the forward; ties go to the lowest id."""
    distance = F.abs(F.col("strike") - F.col("fwd"))
    known = with_bar(quotes, "ts", width).withColumn("distance", distance).where(F.col("distance").isNotNull())
    return dedup_latest(known, ATM_GROUP, [F.col("distance").asc(), F.col("quote_id").asc()])


def hhi(df: DataFrame, group: list[str], part: str, weight: str) -> DataFrame:
    """Herfindahl index of ``weight`` over the parts of each group: two combining aggregations, no window."""
    parts = df.groupBy(*group, part).agg(F.sum(weight).cast("double").alias("_w"))
    total = F.sum("_w")
    return parts.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("_w") * F.col("_w")), total * total).alias("hhi"),
        F.count_if(F.col("_w") > 0).alias("n_parts"),
    )


def _near_atm(quotes: DataFrame, width: str, tenor: int) -> DataFrame:
    """Per variety, bar and side the near tenor's quote nearest the forward; ties go to the lowest id."""
    distance = F.abs(F.col("strike") - F.col("fwd"))
    known = with_bar(quotes, "ts", width).withColumn("distance", distance).where(F.col("distance").isNotNull() & (F.col("tenor_days") >= tenor))
    listed = known.groupBy(*ATM_GROUP).agg(F.min("distance").alias("distance"))
    near = F.col("tenor_days") == F.min("tenor_days").over(Window.partitionBy(*KEY))
    least = stage(listed.withColumn("_near", near).where(F.col("_near") & F.col("cp").isin("C", "P")).drop("_near"), "least-distances")
    same = [known[k].eqNullSafe(least[k]) for k in (*ATM_GROUP, "distance")]
    at = known.join(least, same, "left_semi").withColumn("_at", id_order("quote_id", *FIELDS))
    return at.groupBy(*KEY, "cp").agg(*[F.min_by(f, "_at").alias(f) for f in FIELDS])


def build_greeks(quotes: DataFrame, width: str = WIDTH, tenor: int = 30) -> DataFrame:
    """At-the-money Greeks of the near tenor, and HHI of open interest by strike, per variety and bar.

    The near tenor of a bar is the nearest listed one of at least ``tenor`` days. The quotes
    are read three times, and each time combine in a hash table on the map side: open interest by
    strike, the least distance of each tenor and side, and, of the quotes at that distance, the
    lowest id. A table of least distances, one row per bar, tenor and side, is written between.
    """
    bars = hhi(with_bar(quotes, "ts", width), KEY, "strike", "open_interest").withColumnRenamed("hhi", "oi_hhi")
    atm = _near_atm(quotes, width, tenor)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    priced = greeks(bars.join(atm.withColumnsRenamed({k: f"_{k}" for k in KEY}), same, "left").select(*KEY, "oi_hhi", *FIELDS, "cp"))
    call, put = F.col("cp") == "C", F.col("cp") == "P"
    return priced.groupBy("variety", "bar").agg(
        F.first("oi_hhi").alias("oi_hhi"),
        F.max(F.when(call, F.col("delta"))).alias("delta_call"),
        F.max(F.when(put, F.col("delta"))).alias("delta_put"),
        *[F.avg(g).alias(g) for g in ("gamma", "vega", "theta")],
    )


def join_features(features: DataFrame, greek_table: DataFrame, keys: tuple[str, ...] = ("variety", "bar")) -> DataFrame:
    """Both tables on their key; rows of one side only are kept and flagged."""
    left = features.withColumn("_f", F.lit(True))
    right = greek_table.withColumn("_g", F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = left.join(right, list(keys), "full_outer")
    return joined.withColumn("has_features", flag("_f")).withColumn("has_greeks", flag("_g")).drop("_f", "_g")
