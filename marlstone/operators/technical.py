"""Trailing technical operators: each takes a ``Trail`` and columns and returns a column.

``half(n)`` is the number of values a window of these operators needs: half of it, two at least. Year-scaled
results use 252 bars.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio
from marlstone.functions.trail import Trail

YEAR = 252.0


def half(n: int) -> int:
    return max(2, n // 2)


def simple_return(t: Trail, price: Column, k: int = 1) -> Column:
    return ratio(price, t.lag(price, k)) - 1


def log_return(t: Trail, price: Column, k: int = 1) -> Column:
    return F.ln(ratio(price, t.lag(price, k)))


def rolling_volatility(t: Trail, ret: Column, n: int = 21, yearly: bool = True) -> Column:
    return t.std(ret, n, half(n)) * (F.sqrt(F.lit(YEAR)) if yearly else F.lit(1.0))


def realized_volatility(t: Trail, ret: Column, n: int = 21) -> Column:
    """Root of summed squares scaled by the window's length, not by the values in it."""
    return F.sqrt(t.sum(ret * ret, n, half(n)) * (YEAR / n))


def rolling_sharpe(t: Trail, ret: Column, n: int = 63) -> Column:
    return ratio(t.mean(ret, n, half(n)), t.std(ret, n, half(n))) * F.sqrt(F.lit(YEAR))


def moving_average(t: Trail, price: Column, n: int = 20) -> Column:
    return t.mean(price, n, half(n))


def ma_ratio(t: Trail, price: Column, n: int = 50) -> Column:
    return ratio(price, moving_average(t, price, n)) - 1


def bollinger(t: Trail, price: Column, n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, dev = moving_average(t, price, n), t.std(price, n, half(n))
    upper, lower = mid + width * dev, mid - width * dev
    return {"upper": upper, "lower": lower, "pctb": ratio(price - lower, upper - lower), "bandwidth": ratio(upper - lower, mid)}


def momentum(t: Trail, price: Column, n: int = 63, skip: int = 0) -> Column:
    now = t.lag(price, skip) if skip else price
    return ratio(now, t.lag(price, n)) - 1


def zscore(t: Trail, x: Column, n: int = 21) -> Column:
    return ratio(x - t.mean(x, n, half(n)), t.std(x, n, half(n)))


def volume_features(t: Trail, volume: Column, price: Column, n: int = 21) -> dict[str, Column]:
    return {"log_dollar_volume": F.log1p(volume * price), "volume_zscore": zscore(t, volume, n), "relative_volume": ratio(volume, t.mean(volume, n, half(n)))}


def rolling_beta(t: Trail, asset: Column, market: Column, n: int = 63) -> Column:
    """Covariance of complete pairs over the variance of all the market's values in the window."""
    return ratio(t.covariance(asset, market, n, half(n)), t.over(F.var_samp, market, n, half(n)))


def drawdown(t: Trail, price: Column) -> Column:
    return ratio(price, F.max(price).over(t.so_far())) - 1


def vwap_deviation(t: Trail, high: Column, low: Column, close: Column, volume: Column, n: int = 21) -> Column:
    typical = (high + low + close) / 3
    return ratio(close, ratio(t.sum(typical * volume, n), t.sum(F.when(typical.isNotNull(), volume), n))) - 1


def regression_residual(t: Trail, price: Column, n: int = 63) -> Column:
    """The last log price less its fitted value on a straight line through the window (all values present)."""
    place = t.series(t.number().cast("double"))
    logs = t.series(F.ln(F.when(price > 0, price)))
    w = t.last(n)
    slope = F.covar_pop(logs, place).over(w) * (12.0 / (n * n - 1))
    fitted = F.avg(logs).over(w) + slope * (place - F.avg(place).over(w))
    return F.when(F.count(logs).over(w) == n, logs - fitted)
