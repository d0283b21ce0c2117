"""Tail risk with and without warnings. Inputs are bars or days, bounded by the calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.order import time_order
from tailward.functions.quantile import weighted_quantiles

ALPHA = 0.95
# Cumulative probabilities of 0, 1, 2, ... events of a Poisson distribution with mean 1.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(13)]
METHOD, COMPETITION = "method", "competition"


def log_returns(df: DataFrame, key: str = "variety", ts: str = "bar", px: str = "close") -> DataFrame:
    """Add ``ret``, the log of the price over the key's previous price; null for the first row."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("ret", F.ln(F.try_divide(F.col(px), F.lag(px).over(w))))


def daily_closes(quotes: DataFrame, px: str = "fwd") -> DataFrame:
    """Last price per variety and day."""
    dated = quotes.withColumn("day", F.to_date("ts"))
    at = time_order("ts", F.col("day").cast("timestamp_ntz"), "quote_id")
    return dated.withColumn("_at", at).groupBy("variety", "day").agg(F.max_by(px, "_at").alias("close"))


def _var_spread(known: DataFrame, by: list[str], levels: list[float]) -> DataFrame:
    counts = known.groupBy(*by, "_loss").agg(F.count(F.lit(1)).alias("_n"))
    found = weighted_quantiles(counts, by, "_loss", "_n", levels)
    return found.select(*by, F.col("q").alias("alpha"), F.col("quantile").alias("var"))


def _var_whole(known: DataFrame, by: list[str], levels: list[float]) -> DataFrame:
    found = known.groupBy(*by).agg(F.percentile("_loss", F.array(*[F.lit(a) for a in levels])).alias("_at"))
    return found.select(*by, F.inline(F.arrays_zip(F.array(*[F.lit(a) for a in levels]).alias("alpha"), F.col("_at").alias("var"))))


def cvar(
    df: DataFrame, loss: str = "loss", alphas: list[float] | None = None, by: list[str] | None = None, spread: bool = True
) -> DataFrame:
    """Per group and level: VaR (exact quantile of loss) and CVaR (mean of the losses from VaR on).

    Losses are ranked to 9 digits, so that one equal to VaR counts as equal.
    Quantiles are found over range partitions, so a group that collects many varieties
    does not gather in one task. Without ``spread`` a group's distinct losses are held by one
    task, in fewer jobs: for groups of days, which the calendar bounds.
    """
    levels = alphas or [ALPHA]
    known = df.where(F.col(loss).isNotNull()).withColumn("_loss", F.round(loss, 9))
    on = by or ["_all"]
    if not by:
        known = known.withColumn("_all", F.lit(1))
    cuts = (_var_spread if spread else _var_whole)(known, on, levels).withColumn("var", F.round("var", 12))
    out = known.join(cuts, on).groupBy(*on, "alpha", "var").agg(
        F.avg(F.when(F.col("_loss") >= F.col("var"), F.col(loss))).alias("cvar"),
        F.count(F.lit(1)).alias("n_losses"),
        F.count_if(F.col("_loss") >= F.col("var")).alias("n_tail"),
    )
    return out.drop("_all")


def dual_side(df: DataFrame, ret: str = "ret") -> DataFrame:
    """Losses of a long and of a short position, stacked under ``side``."""
    sides = F.array(
        F.struct(F.lit("long").alias("side"), (-F.col(ret)).alias("loss")),
        F.struct(F.lit("short").alias("side"), F.col(ret).alias("loss")),
    )
    return df.select("*", F.inline(sides))


def alert_days(levels: DataFrame) -> DataFrame:
    """Highest level per variety and day."""
    return levels.groupBy("variety", F.to_date("bar").alias("day")).agg(F.max("level").alias("day_level"))


def _recent_level(h: int) -> Column:
    w = Window.partitionBy("variety").orderBy(F.unix_date("day")).rangeBetween(-h, -1)
    return F.coalesce(F.max("day_level").over(w), F.lit(0))


def _with_alerts(returns: DataFrame, alerts: DataFrame) -> DataFrame:
    """Days with a return (``_priced``) or an alert: one without a price still counts for the days after it."""
    joined = returns.withColumn("_priced", F.lit(True)).join(alerts, ["variety", "day"], "full_outer")
    return joined.withColumn("_priced", F.coalesce("_priced", F.lit(False)))


def de_expose(returns: DataFrame, alerts: DataFrame, h: int = 3, level: int = 2) -> DataFrame:
    """Exposure 0 on the ``h`` days after an alert day, else 1, and the strategy's return.

    ``returns`` and ``alerts`` are per variety and ``day``; an alert day has ``day_level >= level``.
    """
    exposure = F.when(_recent_level(h) >= level, F.lit(0)).otherwise(F.lit(1))
    out = _with_alerts(returns, alerts).withColumn("exposure", exposure).where("_priced").drop("_priced")
    return out.withColumn("strategy_ret", F.col("ret") * F.col("exposure"))


def conventions(exposed: DataFrame) -> DataFrame:
    """Base and strategy losses under both conventions: ``method`` holds the long side, ``competition`` both."""
    both = (
        exposed.where(F.col("ret").isNotNull())
        .select("*", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("_sign")) for s, k in (("long", -1), ("short", 1))])))
        .withColumn("base_loss", F.col("ret") * F.col("_sign"))
        .withColumn("strategy_loss", F.col("strategy_ret") * F.col("_sign"))
        .drop("_sign")
    )
    used = F.when(F.col("side") == "long", F.array(F.lit(METHOD), F.lit(COMPETITION))).otherwise(F.array(F.lit(COMPETITION)))
    return both.select("*", F.explode(used).alias("convention"))


def improvement(losses: DataFrame, by: list[str], alphas: list[float] | None = None, spread: bool = True) -> DataFrame:
    """1 - CVaR(strategy) / CVaR(base) per group and level; ``losses`` has ``base_loss`` and ``strategy_loss``."""
    books = F.array(
        F.struct(F.lit("base").alias("book"), F.col("base_loss").alias("loss")),
        F.struct(F.lit("strategy").alias("book"), F.col("strategy_loss").alias("loss")),
    )
    measured = cvar(losses.select(*by, F.inline(books)), "loss", alphas, [*by, "book"], spread)
    pick = lambda book: F.max(F.when(F.col("book") == book, F.col("cvar")))
    sides = measured.groupBy(*by, "alpha").agg(pick("base").alias("cvar_base"), pick("strategy").alias("cvar_strategy"))
    better = F.lit(1.0) - F.try_divide(F.col("cvar_strategy"), F.col("cvar_base"))
    return sides.withColumn("improvement", better)


def cvar_improvement(exposed: DataFrame, alphas: list[float] | None = None, target: float = 0.1) -> DataFrame:
    """Improvement per convention and side, with a flag for more than ``target``."""
    out = improvement(conventions(exposed), ["convention", "side"], alphas)
    return out.withColumn("meets_target", F.coalesce(F.round("improvement", 9) > F.lit(target), F.lit(False)))


def block_weights(days: DataFrame, draws: int, block: int = 5, seed: int = 1) -> DataFrame:
    """(block, draw, weight): how often each draw takes each block of ``block`` days, Poisson with mean 1; blocks it does not take have no row.

    A weight follows from a hash of seed, block and draw, so draws are the same in every run
    and no table is resampled. The size is that of the calendar times ``draws``.
    """
    blocks = days.select(_block(block).alias("block")).distinct().where("block is not null")
    each = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("block"), F.col("draw")), 256)
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    weight = sum(((F.col("_u") >= F.lit(c)).cast("int") for c in POISSON), F.lit(0))
    return each.withColumn("_u", uniform).select("block", "draw", weight.alias("weight")).where("weight > 0")


def _block(days: int) -> Column:
    return F.floor(F.unix_date("day") / F.lit(days)).cast("int")


def bootstrap_improvement(
    exposed: DataFrame, draws: int = 200, block: int = 5, alpha: float = ALPHA, interval: tuple[float, float] = (0.05, 0.95), target: float = 0.1, seed: int = 1
) -> DataFrame:
    """An interval for the improvement of each convention and side, by drawing blocks of days with Poisson weights.

    All varieties of a day are drawn together, and the days of a block, so what moves together
    stays together. A draw's VaR and CVaR count each loss as often as its block was drawn; one
    without losses, or without a base CVaR, has no improvement and is left out of the interval.

    Result: ``convention``, ``side``, ``n_draws`` with an improvement, ``low``, ``median``, ``high``, and ``share_above`` the target.
    """
    held = conventions(exposed).withColumn("block", _block(block))
    weights = block_weights(exposed, draws, block, seed)
    books = F.inline(F.array(*[F.struct(F.lit(b).alias("book"), F.col(f"{b}_loss").alias("loss")) for b in ("base", "strategy")]))
    by = ["convention", "side", "book", "draw"]
    drawn = held.select("convention", "side", "block", books).where("loss is not null").join(weights, "block").withColumn("_loss", F.round("loss", 9))
    cuts = drawn.groupBy(*by).agg(F.round(F.percentile("_loss", F.lit(alpha), F.col("weight")), 12).alias("var"))
    tail = F.when(F.col("_loss") >= F.col("var"), F.col("weight"))
    risk = drawn.join(cuts, by).groupBy(*by).agg(F.try_divide(F.sum(F.col("loss") * tail), F.sum(tail)).alias("cvar"))
    pick = lambda book: F.max(F.when(F.col("book") == book, F.col("cvar")))
    better = risk.groupBy("convention", "side", "draw").agg((F.lit(1.0) - F.try_divide(pick("strategy"), pick("base"))).alias("improvement"))
    at = F.percentile("improvement", F.array(F.lit(interval[0]), F.lit(0.5), F.lit(interval[1])))
    found = better.groupBy("convention", "side").agg(F.count("improvement").alias("n_draws"), at.alias("_at"), F.avg((F.round("improvement", 9) > target).cast("double")).alias("share_above"))
    return found.select("convention", "side", "n_draws", *[F.get("_at", F.lit(k)).alias(n) for k, n in enumerate(("low", "median", "high"))], "share_above")


def robust_grid(returns: DataFrame, alerts: DataFrame, hs: list[int], alphas: list[float], levels: list[int]) -> DataFrame:
    """Improvement for every combination of days, level and alpha, in one pass.

    The look-backs share one sort; each day then fans out to the (h, level) cells, a
    constant factor, and all alphas come from one percentile aggregate; a cell has one row per variety and day.
    """
    wide = _with_alerts(returns, alerts).select("_priced", "variety", "day", "ret", *[_recent_level(h).alias(f"_recent_{h}") for h in hs]).where("_priced")
    cells = F.array(
        *[
            F.struct(F.lit(h).alias("h"), F.lit(lv).alias("level"), (F.col(f"_recent_{h}") < lv).cast("int").alias("exposure"))
            for h in hs
            for lv in levels
        ]
    )
    exposed = wide.select("variety", "day", "ret", F.inline(cells)).withColumn("strategy_ret", F.col("ret") * F.col("exposure"))
    return improvement(conventions(exposed), ["h", "level", "convention", "side"], alphas, spread=False)


def robust_subperiod(exposed: DataFrame, alphas: list[float] | None = None) -> DataFrame:
    """Improvement by variety, by week and overall, per convention and side."""
    scopes = F.array(
        F.concat(F.lit("variety "), F.col("variety").cast("string")),
        F.concat(F.lit("week "), F.trunc("day", "week").cast("string")),
        F.lit("overall"),
    )
    losses = conventions(exposed).select("*", F.explode(scopes).alias("scope"))
    return improvement(losses, ["scope", "convention", "side"], alphas)
