"""Pieces shared by the operators: words, shared tables, Arrow batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space other than the blank; words are what lies between any of these and blanks.
_BLANKS = "\t\n\x0b\x0c\r"


def blanked(text: Column) -> Column:
    """The text with every ASCII white-space character turned into one blank; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.array_remove(F.split(blanked(text), " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset on a local master, as in tests, a folder of the warehouse is set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/shared"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders written inside the innermost ``scope``.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
#: Those of the scope around it.
_outer: ContextVar[list[str] | None] = ContextVar("outer", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read it back, so a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``written`` makes inside are removed at the end, but for those taken out of the list yielded.

    What leaves the scope must be written itself: it may not read tables that are removed.
    """
    paths: list[str] = []
    tokens = _outer.set(_written.get()), _written.set(paths)
    try:
        yield paths
    finally:
        _outer.reset(tokens[0])
        _written.reset(tokens[1])
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders from whatever store they are in."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def result(df: DataFrame, label: str, paths: list[str]) -> DataFrame:
    """``written`` inside a scope, and taken out of its list: the scope's result stays (in the outer scope, if any)."""
    out = written(df, label)
    _outer.get().append(paths.pop()) if _outer.get() is not None else paths.pop()
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str, small: int, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with a written ``table`` that has one row a ``key``.

    A table of at most ``small`` rows is broadcast; its rows must be of fixed width. For a larger one the rows of
    each key are spread over salts by the column ``spread``, so that a hot key is no single task.
    """
    if table.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(table), key, how)
    (salt,) = fresh(rows, "salt")
    salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return rows.join(salted, [key, salt], how).drop(salt)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: few rows to an Arrow batch, since texts may be long. Spark bounds a
    batch's bytes too (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def numbered(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``rows`` with a gapless number from 0 in the order given, written to the shared folder.

    Ranges of the order are sorted apart, so no task holds all rows; ``order`` should tell rows apart that many
    share their first columns. Only one number a partition is broadcast.
    """
    (at,) = fresh(rows, "at")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = written(rows, "numbered").withColumn("part", F.shiftright(at, 33))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a partition
    rows = rows.join(F.broadcast(parts), "part")
    return rows.withColumn(name, F.col("base") + F.col(at) - F.shiftleft(F.col("part"), 33)).drop(at, "part", "base")


class Cache(dict):
    """A dict that computes what is missing and starts anew beyond ``bound`` entries."""

    def __init__(self, make, bound: int = 300_000):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = edges.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        ends = F.explode(F.array("u", "v")).alias("u")
        out = out.select(ends, F.col("m").alias("v")).where("u <> v")
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links ``(u, v)`` by alternating large and small stars.

    Returns ``(u, v)``: each node but the smallest of its component, with that smallest node.
    Each round is written to the shared folder; only two numbers a round reach the driver.
    """
    with scope(edges.sparkSession) as paths:
        now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        now, seen = written(now, "links"), None
        for _ in range(rounds):
            mark = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
            if mark == seen or not mark[0]:
                return result(now, "components", paths)
            seen, now = mark, written(_star(_star(now, True), False), "stars")
            remove(edges.sparkSession, [paths.pop(-2)])
    raise RuntimeError(f"components did not settle in {rounds} rounds")
