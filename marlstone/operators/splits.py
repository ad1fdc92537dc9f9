"""Walk-forward splits over whole dates, and fixed-length feature sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walk_forward(df: DataFrame, folds: int, test: int, embargo: int = 0, least: int = 100, expanding: bool = True, train: int = 0, date: str = "date") -> DataFrame:
    """Rows with ``fold`` and ``part`` (train or test). Tests tile the last ``folds * test`` dates.

    A date trains a fold if it lies before the test's start less the embargo (and within ``train`` dates of
    it unless expanding). Folds with fewer than ``least`` training dates are left out. Dates are numbered
    after reducing to distinct ones, so the number of rows does not matter.
    """
    spark = df.sparkSession
    days = df.select(date).distinct()
    w = Window.partitionBy(F.lit(0))
    days = days.withColumns({"i": F.row_number().over(w.orderBy(date)) - 1, "n": F.count("*").over(w)})
    spine = F.broadcast(spark.range(folds).select(F.col("id").cast("int").alias("fold")))  # one row a fold
    first = F.col("n") - (folds - F.col("fold")) * test
    d = days.crossJoin(spine).withColumns({"a": first, "b": first + test, "until": first - embargo})
    training = (F.col("i") < F.col("until")) & (F.lit(expanding) | (F.col("i") >= F.col("until") - train))
    part = F.when(training, "train").when((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")), "test")
    d = d.where((F.col("a") >= 0) & (F.col("until") >= least)).withColumn("part", part).where("part is not null")
    return df.join(d.select(date, "fold", "part"), date)  # a few rows a date; the planner broadcasts by size


def sequences(df: DataFrame, features: list[str], n: int, entity: str = "ticker", date: str = "date") -> DataFrame:
    """Adds ``sequence`` (n rows of features, left-padded with zeros) and ``valid`` (which rows are real)."""
    w = Window.partitionBy(entity).orderBy(date).rowsBetween(-(n - 1), 0)
    got = F.collect_list(F.array(*(F.col(f).cast("float") for f in features))).over(w)
    lack = F.lit(n) - F.size("__got")
    zero = F.array(*(F.lit(0.0).cast("float") for _ in features))
    d = df.withColumn("__got", got)
    d = d.withColumn("sequence", F.concat(F.array_repeat(zero, lack), F.col("__got")))
    return d.withColumn("valid", F.concat(F.array_repeat(F.lit(False), lack), F.array_repeat(F.lit(True), F.size("__got")))).drop("__got")
