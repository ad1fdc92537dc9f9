"""Canonical JSON, hashes and the order-free content hash of a DataFrame."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, default=str)


def semantic_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """Depends on schema and rows with their multiplicity, not on order or partitions: one aggregate."""
    r = df.agg(*sums(df)).first()
    return hash_of(df, r["n"], r["a"], r["b"])


def sums(df: DataFrame) -> list[Column]:
    """Aggregates ``n``, ``a`` and ``b`` that add up over any parts of the rows (b by exclusive or)."""
    row = F.struct(*(F.col(c) for c in sorted(df.columns)))
    a, b = F.xxhash64(row), F.xxhash64(F.lit("second"), row)
    return [F.count("*").alias("n"), F.coalesce(F.sum(a.cast("decimal(38,0)")), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(b), F.lit(0)).alias("b")]


def hash_of(df: DataFrame, n: int, a, b: int) -> str:
    kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return semantic_hash([kinds, int(n), str(int(a)), int(b)])
