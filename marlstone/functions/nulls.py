"""Missing values are null everywhere: NaN and infinities become null where data enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def finite(x: Column | str) -> Column:
    """The value if it is a finite number, else null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def scrub(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN and infinities of the floating columns (or those named) to null."""
    kinds = (DoubleType, FloatType)
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return df.withColumns({c: finite(c) for c in names}) if names else df


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a, b)


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; null stays null."""
    y = x
    y = F.greatest(y, F.lit(float(low))) if low is not None else y
    y = F.least(y, F.lit(float(high))) if high is not None else y
    return F.when(x.isNotNull(), y)
