"""Trailing statistical operators; every window needs all its values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.nulls import clip, positive, ratio
from marlstone.functions.trail import Trail
from marlstone.operators.technical import YEAR

HURST_LAGS = (2, 4, 8, 16, 32)


def _log_ratio(a: Column, b: Column) -> Column:
    return F.ln(ratio(positive(a), positive(b)))


def _yearly(variance: Column) -> Column:
    return F.sqrt(clip(variance, low=0.0)) * F.sqrt(F.lit(YEAR))


def parkinson_volatility(t: Trail, high: Column, low: Column, n: int = 21) -> Column:
    r = _log_ratio(high, low)
    return _yearly(t.mean(r * r, n) / (4 * math.log(2)))


def garman_klass_volatility(t: Trail, open_: Column, high: Column, low: Column, close: Column, n: int = 21) -> Column:
    hl, co = _log_ratio(high, low), _log_ratio(close, open_)
    return _yearly(t.mean(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, n))


def rogers_satchell_volatility(t: Trail, open_: Column, high: Column, low: Column, close: Column, n: int = 21) -> Column:
    up = _log_ratio(high, close) * _log_ratio(high, open_)
    return _yearly(t.mean(up + _log_ratio(low, close) * _log_ratio(low, open_), n))


def rolling_skewness(t: Trail, x: Column, n: int = 63) -> Column:
    """Bias-adjusted."""
    return t.over(F.skewness, x, n) * (math.sqrt(n * (n - 1)) / (n - 2))


def rolling_kurtosis(t: Trail, x: Column, n: int = 63) -> Column:
    """Bias-adjusted excess."""
    return ((n + 1) * t.over(F.kurtosis, x, n) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def downside_deviation(t: Trail, ret: Column, n: int = 63) -> Column:
    low = clip(ret, high=0.0)
    return F.sqrt(t.mean(low * low, n)) * F.sqrt(F.lit(YEAR))


def autocorrelation(t: Trail, x: Column, n: int = 63, k: int = 1) -> Column:
    past = t.series(t.lag(x, k))
    return t.correlation(x, past, n)


def partial_autocorrelation_2(t: Trail, x: Column, n: int = 63) -> Column:
    one, two = t.series(autocorrelation(t, x, n, 1)), t.series(autocorrelation(t, x, n, 2))
    return clip(ratio(two - one * one, 1 - one * one), -1.0, 1.0)


def hurst_exponent(t: Trail, price: Column, n: int = 128, lags: tuple[int, ...] = HURST_LAGS) -> Column:
    """Slope of the log spread of differences on the log lag; lags without spread are left out."""
    logs = t.series(F.ln(positive(price)))
    full = F.count(logs).over(t.last(n)) == n
    points = []
    for k in lags:
        step = t.series(logs - t.lag(logs, k))
        spread = t.series(F.stddev_pop(step).over(t.last(n - k)))
        points.append((math.log(k), F.when(spread > 0, F.ln(spread))))
    used = [y.isNotNull().cast("double") for _, y in points]
    zero = [F.coalesce(y, F.lit(0.0)) for _, y in points]

    def total(terms: list[Column]) -> Column:
        out = terms[0]
        for c in terms[1:]:
            out = out + c
        return out

    m, sx = total(used), total([x * u for (x, _), u in zip(points, used, strict=True)])
    sy, sxx = total(zero), total([x * x * u for (x, _), u in zip(points, used, strict=True)])
    sxy = total([x * y for (x, _), y in zip(points, zero, strict=True)])
    return F.when(full & (m >= 2), ratio(m * sxy - sx * sy, m * sxx - sx * sx))


def variance_ratio(t: Trail, ret: Column, n: int = 63, q: int = 5) -> Column:
    """Overlapping variance ratio with its unbiased scale."""
    mean = F.avg(ret).over(t.last(n))
    sums = t.series(t.sum(ret, q))
    m = n - q + 1
    w = t.last(m)
    long_ = F.sum(sums * sums).over(w) - 2 * q * mean * F.sum(sums).over(w) + m * q * q * mean * mean
    return F.when(F.count(ret).over(t.last(n)) == n, ratio(long_ / (q * m * (1 - q / n)), F.var_samp(ret).over(t.last(n))))
