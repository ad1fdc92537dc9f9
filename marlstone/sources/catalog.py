"""A catalog of small records with unique keys: of several writers of one key exactly one wins, and all see its record."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.canonical import canonical_json
from marlstone.sources.files import Folder

_KEY = re.compile(r"^[\w.-]+$")
#: Fields that a record of each table must have.
TABLES = {"features": ("name", "version", "identity"), "materializations": ("object", "request", "content")}


class CatalogError(ValueError):
    pass


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def _name(self, table: str, key: str) -> str:
        if table not in TABLES or not _KEY.match(key):
            raise CatalogError(f"no such table or key: {table} {key}")
        return f"{table}/{key}.json"

    def insert(self, table: str, key: str, record: dict[str, Any]) -> tuple[dict[str, Any], bool]:
        """The record under the key, and whether it is this one; an existing one stays as it is."""
        lost = [f for f in TABLES[table] if record.get(f) in (None, "")] if table in TABLES else []
        if lost:
            raise CatalogError(f"the record lacks {lost}")
        name = self._name(table, key)
        if not self.folder.exists(name) and self.folder.insert_json(name, record):
            return record, True
        return self.folder.read_json(name), False

    def find(self, table: str, key: str) -> dict[str, Any] | None:
        name = self._name(table, key)
        return self.folder.read_json(name) if self.folder.exists(name) else None

    def rows(self, table: str) -> DataFrame:
        """(key, record as JSON) of all records, read by the cluster."""
        if table not in TABLES:
            raise CatalogError(f"no table {table}")
        rows = [(n.removesuffix(".json"), canonical_json(self.folder.read_json(f"{table}/{n}"))) for n in self.folder.names(table) if n.endswith(".json")]
        return self.spark.createDataFrame(rows, "key string, record string")
