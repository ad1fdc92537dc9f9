"""Experiment runs: parameters, metrics and tags as JSON or SQLite rows."""

from __future__ import annotations

import json
import sqlite3
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.files import Folder


@dataclass
class Run:
    name: str
    params: dict[str, Any] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    dataset: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def row(self) -> dict[str, Any]:
        return {"run_id": self.run_id, "name": self.name, "at": self.at, "params": json.dumps(self.params, sort_keys=True, default=str), "metrics": json.dumps(self.metrics, sort_keys=True), "tags": json.dumps(self.tags, sort_keys=True), "dataset": self.dataset}


class JsonTracker:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def log(self, run: Run) -> None:
        self.folder.write_json(f"{run.run_id}.json", run.row())

    def runs(self) -> DataFrame:
        rows = [self.folder.read_json(n) for n in self.folder.names() if n.endswith(".json")]
        return self.spark.createDataFrame(rows, "run_id string, name string, at string, params string, metrics string, tags string, dataset string")


class SqliteTracker:
    def __init__(self, path: str):
        self.db = sqlite3.connect(path)
        self.db.execute("create table if not exists runs (run_id text primary key, name text, at text, params text, metrics text, tags text, dataset text)")

    def log(self, run: Run) -> None:
        with self.db:
            self.db.execute("insert into runs values (:run_id, :name, :at, :params, :metrics, :tags, :dataset)", run.row())

    def runs(self) -> list[tuple]:
        return self.db.execute("select * from runs order by at").fetchall()


class NoTracker:
    """Keeps nothing."""

    def log(self, run: Run) -> None:
        """Forget the run."""

    def runs(self) -> list[tuple]:
        return []


def tracker(kind: str, spark: SparkSession, root: str):
    """A tracker by kind: json, sqlite or none."""
    made = {"json": lambda: JsonTracker(spark, root), "sqlite": lambda: SqliteTracker(root), "none": NoTracker}
    if kind not in made:
        raise ValueError(f"no tracker {kind!r}")
    return made[kind]()
