"""Operators across the entities of one date, and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio
from marlstone.functions.trail import Trail


def percent_rank_average(x: Column, date: str = "date") -> Column:
    """Average-tie rank over the number of values; null stays null. The mean of a value's first place counted from
    below and its last one, which is its first from above."""
    w = Window.partitionBy(date)
    n = F.count(x).over(w)
    first, above = F.rank().over(w.orderBy(x.asc_nulls_last())), F.rank().over(w.orderBy(x.desc_nulls_last()))
    return F.when(x.isNotNull(), ratio((first + n + 1 - above) / 2, n))


def zscore(x: Column, date: str = "date") -> Column:
    w = Window.partitionBy(date)
    return ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def demean(x: Column, date: str = "date") -> Column:
    return x - F.avg(x).over(Window.partitionBy(date))


def forward_targets(t: Trail, price: Column, horizon: int = 1) -> dict[str, Column]:
    """Forward return, and its direction (1.0 above zero, else 0.0; null where unknown)."""
    ahead = ratio(t.lead(price, horizon), price) - 1
    return {"target_forward_return": ahead, "target_direction": F.when(ahead.isNotNull(), (ahead > 0).cast("double"))}


def top_k(df: DataFrame, score: str, k: int, date: str = "date", entity: str = "ticker", largest: bool = True, floor: float | None = None) -> DataFrame:
    """The k best of each date, ties by entity; ``floor`` keeps only scores beyond it."""
    s = F.col(score)
    rows = df.where(s.isNotNull())
    if floor is not None:
        rows = rows.where(s > floor if largest else s < floor)
    place = F.row_number().over(Window.partitionBy(date).orderBy(s.desc() if largest else s.asc(), entity))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def quantile_count(n: Column, share: float) -> Column:
    """At least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(n * share).cast("int"))
