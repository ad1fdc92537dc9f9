"""Content-addressed tensors: surfaces as Parquet arrays, a manifest with their digest, verified reads."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from marlstone.sources.canonical import content_hash, semantic_hash
from marlstone.sources.files import Folder


class TensorError(ValueError):
    pass


class TensorStore:
    """Objects are named by the hash of their settings and content; writing the same again changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def write(self, tensor: DataFrame, settings: dict[str, Any]) -> str:
        stage = f"staging/{uuid.uuid4().hex}"
        try:
            tensor.write.option("compression", "zstd").parquet(self.folder.child(stage))
            wrote = self.spark.read.parquet(self.folder.child(stage))
            content = content_hash(wrote)
            name = semantic_hash([settings, content])
            if not self.folder.exists(f"objects/{name}"):
                self.folder.move(stage, f"objects/{name}")
            self.folder.insert_json(f"manifests/{name}.json", {"object": name, "settings": settings, "content": content, "schema": json.loads(wrote.schema.json())})
            return name
        finally:
            self.folder.remove(stage)

    def manifest(self, name: str) -> dict[str, Any]:
        if not self.folder.exists(f"manifests/{name}.json"):
            raise TensorError(f"no tensor {name}")
        return self.folder.read_json(f"manifests/{name}.json")

    def read(self, name: str, verify: bool = True) -> DataFrame:
        m = self.manifest(name)
        d = self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(self.folder.child(f"objects/{name}"))
        if verify and (content_hash(d) != m["content"] or semantic_hash([m["settings"], m["content"]]) != name):
            raise TensorError("the tensor was changed")
        return d

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.folder.names("manifests") if n.endswith(".json")]
