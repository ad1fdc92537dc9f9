"""Exchange bundles of versioned records: Parquet by year, a manifest whose hash is the bundle's id, as-of views."""

from __future__ import annotations

import uuid
from datetime import datetime
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import bitemporal as bi
from marlstone.sources.canonical import content_hash, hash_of, semantic_hash, sums
from marlstone.sources.files import Folder

CONTRACT, VERSIONS = "panel-bundle", ("1.0.0", "1.1.0")
#: Record sets: identity columns, and whether they are required.
SETS = {"prices": (["instrument_id", "date"], True), "universe": (["membership_id"], False), "corporate_actions": (["action_id"], False)}


class BundleError(ValueError):
    pass


class View(NamedTuple):
    prices: DataFrame
    universe: DataFrame | None
    corporate_actions: DataFrame | None


def check(name: str, df: DataFrame) -> None:
    """All rules of a record set in one aggregate; any broken one is an error."""
    rules = bi.ACTION_RULES if name == "corporate_actions" else None
    found = bi.violations(df, SETS[name][0], [c for c in ("ticker", "source") if c in df.columns], rules, prices=name == "prices").first().asDict()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise BundleError(f"{name}: {broken}")


def export(spark: SparkSession, root: str, sets: dict[str, DataFrame], source: dict[str, Any]) -> str:
    """Publish a bundle and return its id; the same content gives the same id and is not written twice."""
    folder, stage = Folder(spark, root), f"staging/{uuid.uuid4().hex}"
    try:
        records = {}
        for name, df in sets.items():
            check(name, df)
            d = df.withColumn("year", F.year("effective_at"))
            d.repartitionByRange("year", "effective_at", *SETS[name][0]).sortWithinPartitions("year", "effective_at", *SETS[name][0]).write.partitionBy("year").parquet(folder.child(f"{stage}/{name}"))
            wrote = _read(spark, folder, stage, name)
            r = wrote.agg(*sums(wrote), F.min("effective_at").alias("first"), F.max("available_at").alias("last")).first()
            records[name] = {"content": hash_of(wrote, r["n"], r["a"], r["b"]), "rows": r["n"], "first": str(r["first"]), "last_available": str(r["last"]), "columns": sorted(df.columns)}
        body = {"contract": CONTRACT, "version": VERSIONS[-1], "records": records, "source": source}
        bundle = semantic_hash(body)
        if not folder.exists(bundle):
            folder.write_json(f"{stage}/manifest.json", body | {"bundle": bundle})
            folder.move(stage, bundle)
        return bundle
    finally:
        folder.remove(stage)


def _read(spark: SparkSession, folder: Folder, bundle: str, name: str) -> DataFrame:
    return spark.read.parquet(folder.child(f"{bundle}/{name}")).drop("year")


def manifest(spark: SparkSession, root: str, bundle: str) -> dict[str, Any]:
    m = Folder(spark, root).read_json(f"{bundle}/manifest.json")
    body = {k: v for k, v in m.items() if k != "bundle"}
    if m["contract"] != CONTRACT or m["version"] not in VERSIONS or m["bundle"] != bundle or semantic_hash(body) != bundle:
        raise BundleError("the manifest is not of this bundle")
    return m


def validate(spark: SparkSession, root: str, bundle: str) -> dict[str, Any]:
    """Contents against the manifest, and no undeclared files."""
    folder, m = Folder(spark, root), manifest(spark, root, bundle)
    extra = set(folder.names(bundle)) - {"manifest.json", *m["records"]}
    if extra:
        raise BundleError(f"undeclared files: {sorted(extra)}")
    for name, r in m["records"].items():
        d = _read(spark, folder, bundle, name)
        if sorted(d.columns) != r["columns"] or content_hash(d) != r["content"]:
            raise BundleError(f"{name} does not have the declared content")
        check(name, d)
    return m


def load(spark: SparkSession, root: str, bundle: str, at: datetime | None = None) -> View:
    """Records, or with an instant the latest revisions visible then (prices also in force)."""
    folder, m = Folder(spark, root), manifest(spark, root, bundle)

    def of(name: str) -> DataFrame | None:
        if name not in m["records"]:
            return None
        d = _read(spark, folder, bundle, name)
        return d if at is None else bi.as_of(d, at, SETS[name][0], effective=name == "prices")

    return View(*(of(n) for n in SETS))
