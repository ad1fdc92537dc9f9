"""Tables in the folder that driver and executors share, and a calendar grid without a product of two tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A calendar has fewer distinct dates than this; beyond it something else was passed as dates.
MAX_DATES = 200_000


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset on a local master, as in tests, a folder of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read it back, so that what is used often is made once."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def calendar_grid(dates: DataFrame, entities: DataFrame, date: str = "date", entity: str = "ticker") -> DataFrame:
    """Every date with every entity. The calendar is one row, of checked size, that each entity explodes."""
    days = dates.agg(F.collect_set(date).alias("days"))
    days = days.select(F.lit(0).alias("one"), F.when(F.size("days") <= MAX_DATES, F.col("days")).otherwise(F.raise_error(F.lit("too many dates"))).alias("days"))
    each = entities.select(entity).distinct().withColumn("one", F.lit(0)).join(F.broadcast(days), "one")
    return each.select(F.explode("days").alias(date), entity)


def numbered(rows: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """``rows`` with a gapless number from 0 in the order given: ranges are sorted apart, so no task holds all rows."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = written(rows, "numbered").withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # one row a partition
    rows = rows.join(F.broadcast(parts), "__part")
    return rows.withColumn(name, F.col("__base") + F.col("__at") - F.shiftleft(F.col("__part"), 33)).drop("__at", "__part", "__base")


def running(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``run_<column>``: sums from the first row up to this one by ``order``, whose values are distinct.

    Ranges are sorted apart and summed within; only one row a partition is broadcast to set them end to end.
    """
    rows = written(rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()), "running")
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("__part").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns))  # one row a partition
    rows = rows.withColumns({f"run_{c}": F.sum(c).over(inside) for c in columns}).join(F.broadcast(parts), "__part")
    return rows.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"__{c}") for c in columns}).drop("__part", *(f"__{c}" for c in columns))
