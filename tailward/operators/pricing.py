"""Undiscounted Black-76: prices, Greeks and implied volatility. Tenor is in days of a 365-day year."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailward.functions.normal import FAR_TAIL, INV_SQRT_2PI, LOWER, UPPER, norm_cdf, norm_pdf

DAYS = 365.0


def _with_d(df: DataFrame, fwd: str, strike: str, tenor: str, iv: str) -> DataFrame:
    """Add the standardised terms as columns, so that each is computed once per row."""
    total = F.col(iv) * F.sqrt(F.col(tenor) / F.lit(DAYS))
    d1 = F.try_divide(F.ln(F.try_divide(F.col(fwd), F.col(strike))), F.col("_sd")) + F.col("_sd") / 2
    return (
        df.withColumn("_sd", total)
        .withColumn("_d1", d1)
        .withColumn("_d2", F.col("_d1") - F.col("_sd"))
        .withColumn("_n1", norm_cdf(F.col("_d1")))
        .withColumn("_n2", norm_cdf(F.col("_d2")))
    )


def black76_price(
    df: DataFrame, fwd: str = "fwd", strike: str = "strike", tenor: str = "tenor_days", iv: str = "iv", cp: str = "cp", out: str = "price"
) -> DataFrame:
    """Add the option value in ``out``."""
    f, k, n1, n2 = F.col(fwd), F.col(strike), F.col("_n1"), F.col("_n2")
    call = f * n1 - k * n2
    put = k * (F.lit(1.0) - n2) - f * (F.lit(1.0) - n1)
    priced = _with_d(df, fwd, strike, tenor, iv).withColumn(out, F.when(F.col(cp) == "C", call).otherwise(put))
    return priced.drop("_sd", "_d1", "_d2", "_n1", "_n2")


def greeks(
    df: DataFrame, fwd: str = "fwd", strike: str = "strike", tenor: str = "tenor_days", iv: str = "iv", cp: str = "cp"
) -> DataFrame:
    """Add ``delta``, ``gamma``, ``vega`` (per unit of volatility) and ``theta`` (per year)."""
    f, years = F.col(fwd), F.col(tenor) / F.lit(DAYS)
    density = norm_pdf(F.col("_d1"))
    return (
        _with_d(df, fwd, strike, tenor, iv)
        .withColumn("delta", F.when(F.col(cp) == "C", F.col("_n1")).otherwise(F.col("_n1") - 1))
        .withColumn("gamma", F.try_divide(density, f * F.col("_sd")))
        .withColumn("vega", f * density * F.sqrt(years))
        .withColumn("theta", -F.try_divide(f * density * F.col(iv), F.sqrt(years) * 2))
        .drop("_sd", "_d1", "_d2", "_n1", "_n2")
    )


def _cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    upper = np.exp(-0.5 * a * a)
    far = a >= FAR_TAIL
    tail = a[far]
    near = np.minimum(a, FAR_TAIL)
    upper *= np.polyval(UPPER, near) / np.polyval(LOWER, near)
    if tail.size:
        fraction = tail + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = tail + k / fraction
        upper[far] = np.exp(-0.5 * tail * tail) / fraction * INV_SQRT_2PI
    return np.where(x >= 0, 1.0 - upper, upper)


def call_volatility(price: np.ndarray, fwd: np.ndarray, strike: np.ndarray, years: np.ndarray, lo: float, hi: float, tol: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Volatilities at which calls are worth ``price`` (NaN where none lies between ``lo`` and ``hi``), and the evaluations each took.

    What is solved for is the value beyond the intrinsic one, that of the option out of the
    money, which loses no digits to a difference. Newton steps by vega start where vega
    bends; a price below the value there is met in logarithms, in which its curve is nearly straight. Each
    value narrows a bracket, and a step that leaves it halves it instead. Rows that are done leave the arrays.
    """
    found, taken = np.full(price.shape, np.nan), np.zeros(price.shape, int)
    with np.errstate(all="ignore"):
        moneyness, root, excess = -np.abs(np.log(fwd / strike)), np.sqrt(years), price - np.maximum(fwd - strike, 0.0)
        near, away = np.minimum(fwd, strike), np.maximum(fwd, strike)
        ok = (price > np.maximum(fwd - strike, 0.0)) & (price < fwd) & (years > 0) & (strike > 0)

        def value(rows: np.ndarray, iv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sd = iv * root[rows]
            d1 = moneyness[rows] / sd + 0.5 * sd
            return near[rows] * _cdf(d1) - away[rows] * _cdf(d1 - sd), near[rows] * root[rows] * INV_SQRT_2PI * np.exp(-0.5 * d1 * d1)

        rows = np.flatnonzero(ok)
        rows = rows[(value(rows, np.full(rows.shape, lo))[0] < excess[rows]) & (excess[rows] < value(rows, np.full(rows.shape, hi))[0])]
        low, high = np.full(rows.shape, lo), np.full(rows.shape, hi)
        bend = np.sqrt(-2 * moneyness[rows]) / root[rows]
        guess = np.clip(bend, 0.1, 0.5 * (lo + hi))
        taken[rows] = 2
        for turn in range(most):
            if not rows.size:
                break
            worth, vega = value(rows, guess)
            taken[rows] += 1
            below = worth < excess[rows]
            low, high = np.where(below, guess, low), np.where(below, high, guess)
            small = excess[rows] < worth if turn == 0 else small
            step = guess - np.where(small, np.log(worth / excess[rows]) * worth, worth - excess[rows]) / vega
            nxt = np.where((step > low) & (step < high), step, 0.5 * (low + high))
            found[rows] = nxt
            still = (np.abs(nxt - guess) > tol) & (high - low > tol)
            rows, low, high, guess, small = rows[still], low[still], high[still], nxt[still], small[still]
    return found, taken


def _solver(lo: float, hi: float, tol: float, most: int):
    @F.pandas_udf("double")
    def solve(price: pd.Series, fwd: pd.Series, strike: pd.Series, tenor: pd.Series, is_call: pd.Series) -> pd.Series:
        p, f, k, t = (s.to_numpy(dtype="float64", na_value=np.nan) for s in (price, fwd, strike, tenor))
        # By parity a put minus its forward intrinsic is a call, so one branch is solved.
        as_call = np.where(is_call.to_numpy(dtype="bool", na_value=False), p, p + f - k)
        found = pd.Series(call_volatility(as_call, f, k, t / DAYS, lo, hi, tol, most)[0])
        return found.where(found.notna(), None)

    return solve


def implied_vol(
    df: DataFrame,
    price: str = "price",
    fwd: str = "fwd",
    strike: str = "strike",
    tenor: str = "tenor_days",
    cp: str = "cp",
    out: str = "implied_vol",
    lo: float = 1e-4,
    hi: float = 5.0,
    tol: float = 1e-11,
    most: int = 60,
) -> DataFrame:
    """Add the volatility that reproduces ``price``, by safeguarded Newton steps over whole Arrow batches.

    Null where the price lies outside the no-arbitrage bounds, or the volatility outside ``lo``
    to ``hi``. Steps end when the volatility moves by less than ``tol``. A Python step: how many steps a row
    takes depends on the row, and an expression fold of steps has no code generation in Spark.
    """
    is_call = F.coalesce(F.col(cp) == "C", F.lit(False))
    return df.withColumn(out, _solver(lo, hi, tol, most)(F.col(price), F.col(fwd), F.col(strike), F.col(tenor).cast("double"), is_call))


def put_call_gap(call: Column, put: Column, fwd: Column, strike: Column) -> Column:
    """Deviation from parity, ``C - P - (F - K)``: zero for consistent prices."""
    return call - put - (fwd - strike)
