"""Trailing liquidity operators; every window needs all its values. Gaps in prices are not filled."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.nulls import clip, positive, ratio
from marlstone.functions.trail import Trail
from marlstone.operators.technical import simple_return


def log_dollar_volume(t: Trail, close: Column, volume: Column, n: int = 21) -> Column:
    return t.mean(F.ln(positive(close * volume)), n)


def volume_change(t: Trail, volume: Column, k: int = 1) -> Column:
    return F.ln(positive(volume)) - F.ln(positive(t.lag(volume, k)))


def relative_volume(t: Trail, volume: Column, n: int = 21) -> Column:
    return ratio(volume, t.mean(volume, n))


def amihud_illiquidity(t: Trail, close: Column, volume: Column, n: int = 21, scale: float = 1e6) -> Column:
    move = t.series(ratio(F.abs(simple_return(t, close)), positive(close * volume)) * scale)
    return t.mean(move, n)


def volume_imbalance(t: Trail, close: Column, volume: Column, n: int = 21) -> Column:
    signed = t.series(F.signum(simple_return(t, close)) * volume)
    return clip(ratio(t.sum(signed, n), t.sum(volume, n)), -1.0, 1.0)


def corwin_schultz_spread(t: Trail, high: Column, low: Column, n: int = 21) -> Column:
    """Mean high-low spread of bar pairs, each floored at zero."""
    k = 3 - 2 * math.sqrt(2)
    before_high, before_low = t.lag(high), t.lag(low)
    square = F.pow(F.ln(ratio(positive(high), positive(low))), F.lit(2.0))
    past = F.pow(F.ln(ratio(positive(before_high), positive(before_low))), F.lit(2.0))
    beta = square + past
    wide = F.when(before_high.isNotNull(), F.greatest(high, before_high)), F.when(before_low.isNotNull(), F.least(low, before_low))
    gamma = F.pow(F.ln(ratio(positive(wide[0]), positive(wide[1]))), F.lit(2.0))
    alpha = (math.sqrt(2) - 1) * F.sqrt(beta) / k - F.sqrt(gamma / k)
    spread = t.series(clip(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), low=0.0))
    return t.mean(spread, n)


def roll_spread(t: Trail, ret: Column, n: int = 21) -> Column:
    past = t.series(t.lag(ret))
    return 2 * F.sqrt(clip(-t.covariance(ret, past, n), low=0.0))


def turnover(t: Trail, volume: Column, shares: Column, n: int = 21) -> Column:
    return t.mean(ratio(volume, shares), n)
