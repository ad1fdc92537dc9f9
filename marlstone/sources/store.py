"""Immutable feature store: content-addressed Parquet objects with manifests, quality gates and bounded reads."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.diagnostics import quality_report
from marlstone.sources.canonical import content_hash, hash_of, semantic_hash, sums
from marlstone.sources.catalog import Catalog
from marlstone.sources.files import Folder

_NAME = re.compile(r"^[A-Za-z_]\w*$")


class StoreError(ValueError):
    pass


@dataclass(frozen=True)
class Request:
    """What is asked to be materialised; its hash and the content's are the object's id."""

    name: str
    columns: tuple[str, ...]
    universe: tuple[str, ...]
    lineage: dict[str, Any] = field(default_factory=dict)
    part: str = "year"
    fit_end: str | None = None
    application_start: str | None = None

    def __post_init__(self) -> None:
        if not all(_NAME.match(c) for c in self.columns):
            raise StoreError("column names must be identifiers")
        if self.fit_end and self.application_start and self.fit_end >= self.application_start:
            raise StoreError("a fitted state must end before it is applied")

    def identity(self) -> str:
        return semantic_hash({"name": self.name, "columns": list(self.columns), "universe": sorted(t.strip().upper() for t in self.universe), "lineage": self.lineage, "part": self.part})


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder, self.catalog = spark, Folder(spark, root), Catalog(spark, f"{root.rstrip('/')}/catalog")

    def lookup(self, request: Request) -> dict[str, Any] | None:
        """The manifest of an object made for the same request, or None."""
        found = self.catalog.find("materializations", request.identity())
        return self.manifest(found["object"]) if found else None

    def manifest(self, object_id: str) -> dict[str, Any]:
        name = f"manifests/{object_id}.json"
        if not self.folder.exists(name):
            raise StoreError(f"no object {object_id}")
        return self.folder.read_json(name)

    def materialize(self, frame: DataFrame, request: Request, gate: bool = True) -> dict[str, Any]:
        """Write once: the same request and content give the same object; other content for it is refused."""
        d = frame.select(F.col("date").cast("date").alias("date"), F.upper(F.trim("ticker")).alias("ticker"), *request.columns)
        part = F.date_format("date", "yyyy" if request.part == "year" else "yyyy-MM")
        stage = f"staging/{uuid.uuid4().hex}"
        # ranges of the order, so that a part of many rows is many files; everything below reads what was written
        d.withColumn("part", part).repartitionByRange("part", "date", "ticker").sortWithinPartitions("part", "date", "ticker").write.partitionBy("part").option("compression", "zstd").parquet(self.folder.child(stage))
        try:
            wrote = self.spark.read.option("basePath", self.folder.child(stage)).parquet(self.folder.child(stage)).select("date", "ticker", *request.columns, F.col("part").cast("string"))
            if gate:
                failed = [r["code"] for r in quality_report(wrote, ["date", "ticker", *request.columns], [t.strip().upper() for t in request.universe], max_missing=1.0, max_gap=10_000).collect() if not r["passed"]]
                if failed:
                    raise StoreError(f"quality checks failed: {failed}")
            per = wrote.groupBy(F.col("part").alias("of")).agg(*sums(wrote), F.min("date").alias("first"), F.max("date").alias("last")).orderBy("of").collect()  # one row a part
            xor = 0
            for r in per:
                xor ^= r["b"]
            content = hash_of(wrote, sum(r["n"] for r in per), sum(int(r["a"]) for r in per), xor)
            object_id = semantic_hash([request.identity(), content])
            before = self.lookup(request)
            if before and before["content"] != content:
                raise StoreError("the request was materialised with other content")
            if before:
                return before
            evidence = [{"part": r["of"], "rows": r["n"], "first": str(r["first"]), "last": str(r["last"]), "content": hash_of(wrote, r["n"], r["a"], r["b"])} for r in per]
            manifest = {"object": object_id, "request": request.identity(), "content": content, "name": request.name, "columns": list(request.columns), "part": request.part, "parts": evidence, "rows": sum(e["rows"] for e in evidence)}
            if not self.folder.exists(f"objects/{object_id}"):
                self.folder.move(stage, f"objects/{object_id}")
            self.folder.write_json(f"manifests/{object_id}.json", manifest)
            # of several writers of one request one wins; another's content for it is refused
            won, mine = self.catalog.insert("materializations", request.identity(), {"object": object_id, "request": request.identity(), "content": content})
            if not mine and won["content"] != content:
                raise StoreError("the request was materialised with other content")
            return manifest
        finally:
            self.folder.remove(stage)

    def _rows(self, object_id: str, columns: list[str]) -> DataFrame:
        path = self.folder.child(f"objects/{object_id}")
        return self.spark.read.option("basePath", path).parquet(path).select("date", "ticker", *columns, F.col("part").cast("string"))

    def validate(self, object_id: str) -> bool:
        """Whether the stored rows still have the manifest's content."""
        m = self.manifest(object_id)
        return content_hash(self._rows(object_id, m["columns"])) == m["content"]

    def _verify(self, object_id: str, m: dict[str, Any], start: str | None, end: str | None) -> None:
        width = 4 if m["part"] == "year" else 7
        wanted = [p for p in m["parts"] if (not start or p["part"] >= start[:width]) and (not end or p["part"] <= end[:width])]
        rows = self._rows(object_id, m["columns"])
        rows = rows.where(F.col("part").isin([p["part"] for p in wanted]))
        found = {r["of"]: hash_of(rows, r["n"], r["a"], r["b"]) for r in rows.groupBy(F.col("part").alias("of")).agg(*sums(rows)).collect()}
        changed = [p["part"] for p in wanted if found.get(p["part"]) != p["content"]]
        if changed:
            raise StoreError(f"parts were changed: {changed}")

    def read(self, object_id: str, start: str | None = None, end: str | None = None, tickers: list[str] | None = None, columns: list[str] | None = None, most: int = 1_000_000, verify: bool = True) -> DataFrame:
        """Rows in order. Predicates and columns reach the files; parts outside the dates are not opened.

        The parts that are opened are first verified against the content the manifest holds for each. More than
        ``most`` rows are an error when the result is read.
        """
        m = self.manifest(object_id)
        if verify:
            self._verify(object_id, m, start, end)
        wanted = columns or m["columns"]
        if not set(wanted) <= set(m["columns"]) or len(tickers or []) > 10_000:
            raise StoreError("unknown columns, or too many tickers")
        d = self._rows(object_id, wanted)
        width = 4 if m["part"] == "year" else 7
        if start:
            d = d.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("part") >= start[:width]))
        if end:
            d = d.where((F.col("date") <= F.lit(end).cast("date")) & (F.col("part") <= end[:width]))
        if tickers:
            d = d.where(F.col("ticker").isin([t.strip().upper() for t in tickers]))
        d = d.drop("part").orderBy("date", "ticker").limit(most + 1)
        over = F.monotonically_increasing_id() >= most  # one ordered partition after the limit
        return d.where(F.when(over, F.raise_error(F.lit("more rows than allowed")).cast("boolean")).otherwise(F.lit(True)))
