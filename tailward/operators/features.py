"""The surface and the eleven features: six of its structure, five of order-flow pressure.

The formulas are this library's own. ``CELL`` sums combine before the first shuffle, so
a variety with a third of all quotes still sends one row per cell and input partition;
everything after that is one row per variety and bar, whose number is set by the calendar
(96 a day for 15-minute bars), so the lag windows per variety stay small at any volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.time import WIDTH, with_bar

KEY = ["variety", "bar"]
CELL = [*KEY, "tenor_days", "mny_idx"]
STRUCTURE = ["atm_iv", "skew", "curvature", "term_slope", "cp_gap", "iv_change"]
FLOW = ["signed_flow", "pc_volume", "depth_imbalance", "volume_surge", "oi_change"]
FEATURES = STRUCTURE + FLOW

# Defaults of parameters: least days of the near and far tenor, steps to a wing, bars of the volume mean.
NEAR, FAR, WING, SURGE_BARS = 30, 90, 2, 20


def iv_surface(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Open-interest-weighted mean IV per variety, bar, tenor, moneyness step and side."""
    iv, oi = F.col("iv"), F.col("open_interest")
    return (
        with_bar(quotes, "ts", width)
        .where(iv.isNotNull())
        .groupBy(*CELL, "cp")
        .agg(F.try_divide(F.sum(iv * oi), F.sum(oi)).alias("iv"), F.sum(oi).alias("open_interest"))
    )


def _cells(quotes: DataFrame, width: str) -> DataFrame:
    """Sums per variety, bar, tenor and moneyness step that every per-bar feature is built from."""
    iv, oi, vol = F.col("iv"), F.col("open_interest"), F.col("volume")
    known = iv.isNotNull()
    sums = []
    for tag, side in (("c", F.col("cp") == "C"), ("p", F.col("cp") == "P")):
        sums += [
            F.sum(F.when(side, iv)).alias(f"iv_{tag}"),
            F.count_if(side & known).alias(f"n_{tag}"),
            F.sum(F.when(side, iv * oi)).alias(f"ivoi_{tag}"),
            F.sum(F.when(side & known, oi)).alias(f"oi_{tag}"),
            F.sum(F.when(side, vol).otherwise(0)).alias(f"vol_{tag}"),
        ]
    return (
        with_bar(quotes, "ts", width)
        .groupBy(*CELL)
        .agg(
            *sums,
            F.sum(vol).alias("vol"),
            F.sum(vol * F.col("side")).alias("flow"),
            F.sum(oi).alias("oi"),
            F.sum(F.col("bid_size") - F.col("ask_size")).alias("depth_diff"),
            F.sum(F.col("bid_size") + F.col("ask_size")).alias("depth"),
        )
    )


def _mean_iv(where: Column, tags: str) -> Column:
    total = sum((F.coalesce(F.col(f"iv_{t}"), F.lit(0.0)) for t in tags), F.lit(0.0))
    n = sum((F.col(f"n_{t}") for t in tags), F.lit(0))
    return F.try_divide(F.sum(F.when(where, total)), F.sum(F.when(where, n)))


def _with_tenors(cells: DataFrame, near: int, far: int) -> DataFrame:
    """Add each bar's near and far tenor: the nearest listed one at or above the wanted days."""
    listed = lambda days: F.min(F.when(F.col("tenor_days") >= days, F.col("tenor_days"))).over(Window.partitionBy(*KEY))
    return cells.withColumn("_near", listed(near)).withColumn("_far", listed(far))


def _per_bar(wing: int) -> dict[str, Column]:
    """Features of one bar alone, as aggregates over its cells."""
    near, far = F.col("tenor_days") == F.col("_near"), F.col("tenor_days") == F.col("_far")
    atm = F.col("mny_idx") == 0
    near_atm = _mean_iv(near & atm, "cp")
    put_wing = _mean_iv(near & (F.col("mny_idx") == -wing), "p")
    call_wing = _mean_iv(near & (F.col("mny_idx") == wing), "c")
    gap = F.try_divide(F.col("ivoi_p"), F.col("oi_p")) - F.try_divide(F.col("ivoi_c"), F.col("oi_c"))
    weight = F.when(gap.isNotNull(), F.col("oi_c") + F.col("oi_p"))
    return {
        "atm_iv": near_atm,
        "skew": put_wing - call_wing,
        "curvature": (put_wing + call_wing) / 2 - near_atm,
        "term_slope": _mean_iv(far & atm, "cp") - near_atm,
        "cp_gap": F.try_divide(F.sum(gap * weight), F.sum(weight)),
        "signed_flow": F.try_divide(F.sum("flow"), F.sum("vol")),
        "pc_volume": F.try_divide(F.sum("vol_p"), F.sum("vol_c")),
        "depth_imbalance": F.try_divide(F.sum("depth_diff"), F.sum("depth")),
        "bar_volume": F.sum("vol"),
        "bar_oi": F.sum("oi"),
    }


def _across_bars(surge_bars: int) -> dict[str, Column]:
    """Features that look at earlier bars of the same variety."""
    w = Window.partitionBy("variety").orderBy("bar")
    recent = w.rowsBetween(-surge_bars, -1)
    previous_oi = F.lag("bar_oi").over(w)
    return {
        "iv_change": F.col("atm_iv") - F.lag("atm_iv").over(w),
        "volume_surge": F.try_divide(F.col("bar_volume"), F.avg("bar_volume").over(recent)),
        "oi_change": F.try_divide(F.col("bar_oi") - previous_oi, previous_oi),
    }


NEEDS = {"iv_change": "atm_iv", "volume_surge": "bar_volume", "oi_change": "bar_oi"}


def build_features(
    quotes: DataFrame,
    width: str = WIDTH,
    only: list[str] | None = None,
    near: int = NEAR,
    far: int = FAR,
    wing: int = WING,
    surge_bars: int = SURGE_BARS,
) -> DataFrame:
    """``variety``, ``bar`` and the eleven features (or ``only`` some): two aggregations, one window pass.

    The near and far tenor of a bar are the nearest listed ones of at least ``near`` and ``far`` days.
    """
    names = only or FEATURES
    alone, across = _per_bar(wing), _across_bars(surge_bars)
    base = sorted({NEEDS.get(n, n) for n in names})
    bars = _with_tenors(_cells(quotes, width), near, far).groupBy(*KEY).agg(*[alone[n].alias(n) for n in base])
    return bars.select(*KEY, *[across[n].alias(n) if n in across else F.col(n) for n in names])


def feat_atm_iv(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Mean near-tenor IV at the money."""
    return build_features(quotes, width, ["atm_iv"])


def feat_skew(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Near-tenor put IV two steps down minus call IV two steps up."""
    return build_features(quotes, width, ["skew"])


def feat_curvature(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Butterfly: mean of the two wing IVs minus the at-the-money IV."""
    return build_features(quotes, width, ["curvature"])


def feat_term_slope(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Far minus near at-the-money IV."""
    return build_features(quotes, width, ["term_slope"])


def feat_cp_gap(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Put minus call IV at the same strike step and tenor, weighted by open interest."""
    return build_features(quotes, width, ["cp_gap"])


def feat_iv_change(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """At-the-money IV minus that of the previous present bar."""
    return build_features(quotes, width, ["iv_change"])


def feat_signed_flow(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Volume signed by the aggressor side, over all volume."""
    return build_features(quotes, width, ["signed_flow"])


def feat_pc_volume(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Put over call volume; null without call volume."""
    return build_features(quotes, width, ["pc_volume"])


def feat_depth_imbalance(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Bid minus ask size, over all quoted size."""
    return build_features(quotes, width, ["depth_imbalance"])


def feat_volume_surge(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Bar volume over the mean of up to 20 previous present bars."""
    return build_features(quotes, width, ["volume_surge"])


def feat_oi_change(quotes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Relative change of summed open interest against the previous present bar."""
    return build_features(quotes, width, ["oi_change"])


def rolling_zscore(
    df: DataFrame, cols: list[str], n: int = 20, key: str = "variety", order: str = "bar", min_std: float = 1e-9
) -> DataFrame:
    """Add ``z_<col>``: distance from the mean of the previous ``n`` bars in their standard deviations.

    Null until ``n`` bars exist, and where those bars are flat (deviation up to ``min_std``,
    which keeps rounding noise of a constant series from turning into a signal).
    Expects one row per key and bar.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    full = F.count(F.lit(1)).over(w) >= n

    def z(c: str) -> Column:
        spread = F.stddev_samp(c).over(w)
        return F.when(full & (spread > min_std), F.try_divide(F.col(c) - F.avg(c).over(w), spread))

    return df.withColumns({f"z_{c}": z(c) for c in cols})
