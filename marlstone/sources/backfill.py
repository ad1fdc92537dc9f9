"""Resumable backfill: a plan of date parts, one checkpoint for each, assembled when all are there."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.canonical import content_hash, semantic_hash
from marlstone.sources.files import Folder


@dataclass(frozen=True)
class Part:
    key: str
    start: date
    end: date


def parts(start: date, end: date, by: str = "year") -> list[Part]:
    """Contiguous parts that cover both ends."""
    out, at = [], start
    while at <= end:
        after = date(at.year + 1, 1, 1) if by == "year" else date(at.year + at.month // 12, at.month % 12 + 1, 1)
        last = min(end, after - timedelta(days=1))
        out.append(Part(f"{at.year:04d}" if by == "year" else f"{at.year:04d}-{at.month:02d}", at, last))
        at = last + timedelta(days=1)
    return out


def window(panel: DataFrame, part: Part, warmup: int, horizon: int) -> DataFrame:
    """Rows a part needs: bars before it for warm-up and after it for targets, counted on the panel's calendar."""
    days = panel.select("date").distinct()
    low = days.where(F.col("date") < F.lit(part.start)).orderBy(F.desc("date")).limit(warmup).agg(F.min("date").alias("low"))
    high = days.where(F.col("date") > F.lit(part.end)).orderBy("date").limit(horizon).agg(F.max("date").alias("high"))
    a, b = low.first()["low"] or part.start, high.first()["high"] or part.end
    return panel.where(F.col("date").between(F.lit(a), F.lit(b)))


class Backfill:
    """Runs a loader for each part; finished parts are kept and verified, failed ones run again next time."""

    def __init__(self, spark: SparkSession, root: str, name: str, plan: list[Part], lineage: dict | None = None):
        self.spark, self.plan = spark, plan
        self.job = semantic_hash({"name": name, "plan": [(p.key, str(p.start), str(p.end)) for p in plan], "lineage": lineage or {}})
        self.folder = Folder(spark, f"{root.rstrip('/')}/{self.job}")

    def _done(self, p: Part) -> bool:
        name = f"{p.key}.json"
        if not self.folder.exists(name):
            return False
        good = content_hash(self.spark.read.parquet(self.folder.child(p.key))) == self.folder.read_json(name)["content"]
        if not good:
            self.folder.remove(name)
        return good

    def status(self) -> dict[str, str]:
        state = {}
        for p in self.plan:
            failed = self.folder.exists(f"{p.key}.error.json")
            state[p.key] = "done" if self.folder.exists(f"{p.key}.json") else "failed" if failed else "pending"
        return state

    def _compute(self, p: Part, load: Callable[[Part], DataFrame]) -> None:
        try:
            rows = load(p).where(F.col("date").between(F.lit(p.start), F.lit(p.end)))
            rows.write.mode("overwrite").parquet(self.folder.child(p.key))
            self.folder.write_json(f"{p.key}.json", {"content": content_hash(self.spark.read.parquet(self.folder.child(p.key)))})
            self.folder.remove(f"{p.key}.error.json")
        except Exception as e:
            self.folder.write_json(f"{p.key}.error.json", {"error": type(e).__name__})
            raise

    def run(self, load: Callable[[Part], DataFrame], threads: int = 2) -> DataFrame:
        """All parts, in date order of their files; jobs of several parts overlap."""
        wait = [p for p in self.plan if not self._done(p)]
        with ThreadPoolExecutor(threads) as pool:
            for f in [pool.submit(self._compute, p, load) for p in wait]:
                f.result()
        return self.assemble()

    def assemble(self) -> DataFrame:
        if lost := [k for k, s in self.status().items() if s != "done"]:
            raise RuntimeError(f"parts are missing: {lost}")
        return self.spark.read.parquet(*(self.folder.child(p.key) for p in self.plan))
