"""Recursions along time: exponential averages, variance recursions, Kalman filters, hysteresis.

These, and windows whose value needs all their members at once (medians, two-way histograms, falls from a peak),
leave the JVM: one grouped pass for each entity computes all of an operator family's columns, windows as views of
the series, some thousands at a time. ``ignore_na`` is off: weights decay across gaps.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marlstone.functions.trail import Trail


def ewm(x: np.ndarray, alpha: float, least: int = 1) -> np.ndarray:
    """Exponential average seeded by the first value; null until ``least`` values came."""
    out = np.full(len(x), np.nan)
    mean, weight, seen = math.nan, 1.0, 0
    for i, v in enumerate(x):
        if not math.isnan(v):
            seen += 1
            if seen == 1:
                mean, weight = v, 1.0
            else:
                weight *= 1 - alpha
                mean = (weight * mean + alpha * v) / (weight + alpha)
                weight = 1.0
        elif seen:
            weight *= 1 - alpha
        if seen >= least:
            out[i] = mean
    return out


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return ewm(x, 2 / (span + 1), max(2, span // 2))


def rsi(price: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's index; 100 where there is no loss."""
    move = np.diff(price, prepend=math.nan)
    gain, loss = ewm(np.where(np.isnan(move), np.nan, np.maximum(move, 0)), 1 / n, n), ewm(np.where(np.isnan(move), np.nan, np.maximum(-move, 0)), 1 / n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(loss), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))


def macd(price: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, np.ndarray]:
    line = ema(price, fast) - ema(price, slow)
    smooth = ewm(line, 2 / (signal + 1), signal)
    return {"macd": line, "macd_signal": smooth, "macd_hist": line - smooth}


def ewma_volatility(ret: np.ndarray, span: int = 21) -> np.ndarray:
    return np.sqrt(ewm(ret * ret, 2 / (span + 1), span)) * math.sqrt(252)


def ewma_variance(x: np.ndarray, decay: float = 0.94, start: float | None = None, floor: float = 1e-12) -> np.ndarray:
    """One-step forecasts: each uses values before it only."""
    out, v = np.empty(len(x)), start if start is not None else float(np.nanmean(x * x))
    for i, r in enumerate(x):
        out[i] = max(v, floor)
        if not math.isnan(r):
            v = decay * out[i] + (1 - decay) * r * r
    return out


def garch_variance(x: np.ndarray, omega: float, alpha: float, beta: float, start: float | None = None, floor: float = 1e-12) -> np.ndarray:
    """GARCH(1,1) one-step forecasts from the long-run variance unless ``start`` is given."""
    if min(omega, alpha, beta) < 0 or alpha + beta >= 1:
        raise ValueError("needs omega, alpha, beta of zero or more and alpha + beta below one")
    out, v = np.empty(len(x)), start if start is not None else omega / (1 - alpha - beta)
    for i, r in enumerate(x):
        out[i] = max(v, floor)
        v = omega + alpha * (0.0 if math.isnan(r) else r * r) + beta * out[i] if not math.isnan(r) else out[i]
    return out


def local_level(x: np.ndarray, state_var: float, noise_var: float, level: float = 0.0, level_var: float = 1.0, floor: float = 1e-12, z: float = 1.959963984540054) -> dict[str, np.ndarray]:
    """Scalar Kalman filter: forecasts before each update (Joseph form), intervals and log-likelihood terms."""
    n = len(x)
    out = {k: np.full(n, np.nan) for k in ("forecast", "variance", "lower", "upper", "filtered", "loglik")}
    for i, y in enumerate(x):
        level_var += state_var
        s = max(level_var + noise_var, floor)
        out["forecast"][i], out["variance"][i] = level, s
        out["lower"][i], out["upper"][i] = level - z * math.sqrt(s), level + z * math.sqrt(s)
        if not math.isnan(y):
            gain, miss = level_var / s, y - level
            out["loglik"][i] = -0.5 * (math.log(2 * math.pi * s) + miss * miss / s)
            level += gain * miss
            level_var = max((1 - gain) ** 2 * level_var + gain * gain * noise_var, floor)
        out["filtered"][i] = level
    return out


def dynamic_linear(y: np.ndarray, design: np.ndarray, state_var: float, noise_var: float, prior_var: float = 1.0, floor: float = 1e-12) -> dict[str, np.ndarray]:
    """Random-walk regression by Kalman filter: one-step forecasts, their variances, filtered coefficients."""
    n, p = design.shape
    beta, cov = np.zeros(p), np.eye(p) * prior_var
    out = {"forecast": np.empty(n), "variance": np.empty(n), "coefficients": np.empty((n, p)), "loglik": np.full(n, np.nan)}
    for i in range(n):
        h = design[i]
        cov = cov + state_var * np.eye(p)
        f, s = float(h @ beta), max(float(h @ cov @ h) + noise_var, floor)
        out["forecast"][i], out["variance"][i] = f, s
        if not (math.isnan(y[i]) or np.isnan(h).any()):
            gain = cov @ h / s
            miss = y[i] - f
            out["loglik"][i] = -0.5 * (math.log(2 * math.pi * s) + miss * miss / s)
            beta = beta + gain * miss
            keep = np.eye(p) - np.outer(gain, h)
            cov = keep @ cov @ keep.T + noise_var * np.outer(gain, gain)
        out["coefficients"][i] = beta
    return out


def no_trade_band(wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Held weights: move to the wanted one only where it differs by the threshold or more."""
    held, out = 0.0, np.empty(len(wanted))
    for i, w in enumerate(np.nan_to_num(wanted)):
        if abs(w - held) >= threshold:
            held = w
        out[i] = held
    return out


def _windows(x: np.ndarray, n: int, made: Callable[..., np.ndarray], *more: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """A value of each full window of ``n``, from blocks of windows; null before the first."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    views = [np.lib.stride_tricks.sliding_window_view(np.asarray(s, float), n) for s in (x, *more)]
    for i in range(0, len(views[0]), at_once):
        block = [v[i : i + at_once] for v in views]
        whole = ~np.logical_or.reduce([np.isnan(v).any(1) for v in block])
        if whole.any():
            values = np.full(len(whole), np.nan)
            values[whole] = made(*(v[whole] for v in block))
            out[n - 1 + i : n - 1 + i + len(whole)] = values
    return out


def median_absolute_deviation(x: np.ndarray, n: int = 63) -> np.ndarray:
    """Median distance from the window's median, unscaled; every value must be there."""
    return _windows(x, n, lambda w: np.median(np.abs(w - np.median(w, axis=1, keepdims=True)), axis=1))


def mutual_information(a: np.ndarray, b: np.ndarray, n: int = 63, bins: int = 8) -> np.ndarray:
    """Plug-in mutual information (nats) of an equal-width two-way histogram over the window.

    The last bin is closed on the right; a constant series has no information. Null if any value is missing.
    """

    def cells(w: np.ndarray) -> np.ndarray:
        low, high = w.min(1, keepdims=True), w.max(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.minimum(bins - 1, np.nan_to_num(np.floor((w - low) * bins / (high - low)))).astype(np.int64)

    def entropy_sum(keys: np.ndarray, kinds: int) -> np.ndarray:
        rows = np.arange(len(keys))[:, None] * kinds
        c = np.bincount((rows + keys).ravel(), minlength=len(keys) * kinds).reshape(-1, kinds).astype(float)
        return (c * np.log(np.maximum(c, 1))).sum(1)

    def of(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        i, j = cells(v), cells(w)
        return np.maximum(0.0, (entropy_sum(i * bins + j, bins * bins) - entropy_sum(i, bins) - entropy_sum(j, bins)) / n + math.log(n))

    return _windows(a, n, of, b)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, missing where b is zero."""
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)


def rolling_skewness(x: np.ndarray, n: int = 63) -> np.ndarray:
    """Bias-adjusted."""

    def of(w: np.ndarray) -> np.ndarray:
        d = w - w.mean(1, keepdims=True)
        return _quotient((d**3).mean(1), (d**2).mean(1) ** 1.5) * (math.sqrt(n * (n - 1)) / (n - 2))

    return _windows(x, n, of)


def rolling_kurtosis(x: np.ndarray, n: int = 63) -> np.ndarray:
    """Bias-adjusted excess."""

    def of(w: np.ndarray) -> np.ndarray:
        d = w - w.mean(1, keepdims=True)
        return ((n + 1) * (_quotient((d**4).mean(1), (d**2).mean(1) ** 2) - 3) + 6) * ((n - 1) / ((n - 2) * (n - 3)))

    return _windows(x, n, of)


def rolling_correlation(a: np.ndarray, b: np.ndarray, n: int = 63) -> np.ndarray:
    def of(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        v, w = v - v.mean(1, keepdims=True), w - w.mean(1, keepdims=True)
        return np.clip(_quotient((v * w).sum(1), np.sqrt((v * v).sum(1)) * np.sqrt((w * w).sum(1))), -1, 1)

    return _windows(a, n, of, b)


def rolling_beta(asset: np.ndarray, market: np.ndarray, n: int = 63) -> np.ndarray:
    def of(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        v, w = v - v.mean(1, keepdims=True), w - w.mean(1, keepdims=True)
        return _quotient((v * w).sum(1), (w * w).sum(1))

    return _windows(asset, n, of, market)


def autocorrelation(x: np.ndarray, n: int = 63, k: int = 1) -> np.ndarray:
    x = np.asarray(x, float)
    return rolling_correlation(x, np.r_[np.full(min(k, len(x)), np.nan), x[:-k]], n)


def partial_autocorrelation_2(x: np.ndarray, n: int = 63) -> np.ndarray:
    one, two = autocorrelation(x, n, 1), autocorrelation(x, n, 2)
    return np.clip(_quotient(two - one * one, 1 - one * one), -1, 1)


def hurst_exponent(price: np.ndarray, n: int = 128, lags: tuple[int, ...] = (2, 4, 8, 16, 32)) -> np.ndarray:
    """Slope of the log spread of differences on the log lag; lags without spread are left out."""
    price = np.asarray(price, float)

    def of(w: np.ndarray) -> np.ndarray:
        spread = np.stack([(w[:, k:] - w[:, :-k]).std(1) for k in lags], 1)
        used = spread > 0
        y, x = np.log(np.where(used, spread, 1.0)), np.log(lags) * used
        m, sx, sy, sxx, sxy = used.sum(1), x.sum(1), y.sum(1), (x * x).sum(1), (x * y).sum(1)
        return np.where(m >= 2, _quotient(m * sxy - sx * sy, m * sxx - sx * sx), np.nan)

    return _windows(np.log(np.where(price > 0, price, np.nan)), n, of)


def variance_ratio(x: np.ndarray, n: int = 63, q: int = 5) -> np.ndarray:
    """Overlapping variance ratio with its unbiased scale."""
    m = n - q + 1

    def of(w: np.ndarray) -> np.ndarray:
        mean = w.mean(1, keepdims=True)
        sums = np.lib.stride_tricks.sliding_window_view(w, q, axis=1).sum(2)
        return _quotient(((sums - q * mean) ** 2).sum(1) / (q * m * (1 - q / n)), w.var(1, ddof=1))

    return _windows(x, n, of)


def rolling_max_drawdown(price: np.ndarray, n: int = 252) -> np.ndarray:
    """Worst fall from a peak within the window; null with fewer than half its rows or a missing price in it."""

    def worst(w: np.ndarray) -> np.ndarray:
        return np.minimum(0.0, (w / np.maximum.accumulate(w, axis=1) - 1).min(1))

    price = np.asarray(price, float)
    out = _windows(price, n, worst)
    for i in range(max(0, n // 2 - 1), min(n - 1, len(price))):  # windows cut short by the start
        if not np.isnan(price[: i + 1]).any():
            out[i] = worst(price[None, : i + 1])[0]
    return out


def along(df: DataFrame, made: Callable[[pd.DataFrame], dict[str, np.ndarray]], columns: list[str], entity: str = "ticker", time: str = "date") -> DataFrame:
    """Append double columns computed from each entity's rows in time order, in one grouped pass."""
    schema = StructType(df.schema.fields + [StructField(c, DoubleType()) for c in columns])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable")
        return rows.assign(**made(rows))[[f.name for f in schema.fields]]

    return df.groupBy(entity).applyInPandas(run, schema)


def on(t: Trail, made: Callable[[pd.DataFrame], dict[str, np.ndarray]], columns: list[str]) -> dict[str, Column]:
    """The same over a ``Trail``: its rows get the columns, which are returned by name."""
    t.df = along(t.result_so_far(), made, columns, t.entity, t.time)
    return {c: F.col(c) for c in columns}
