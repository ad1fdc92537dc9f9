"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: majority bits of XXH64 over 3-word shingles. Links join fingerprints that differ in two
bits or fewer. Distinct fingerprints are dealt by masked patterns: of four 16-bit blocks two stay equal
under two changes, so six masks catch every link. A pattern that holds more than ``GROUP`` fingerprints
is dealt once more by the remaining bits (four 8-bit blocks, again two equal); at most 2**16 fingerprints
then share a pattern, whatever the skew. In each pattern a hierarchical index over Gray-ranked
fingerprints, whose nodes hold the bits that all below share, prunes by accumulated differences.

Each pattern gives a spanning forest, never its pairs; components are joined over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import components, looked_up, small_batches, written

SEED, SHINGLE, NEAR, GROUP, FAN = 42, 3, 2, 4096, 8
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs_of_blocks(width: int, blocks: list[int]) -> list[int]:
    """Masks that keep two of the blocks."""
    one = (1 << width) - 1
    return [one << width * a | one << width * b for a, b in combinations(blocks, 2)]


MASKS = _pairs_of_blocks(16, [0, 1, 2, 3])
#: For a mask of the first deal: masks over the bits it leaves, in four blocks of eight.
SUBMASKS = [_pairs_of_blocks(8, [i for i in range(8) if not m >> 8 * i & 1]) for m in MASKS]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text; 0 if it has no word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    parts = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), np.uint8).reshape(-1, 8)[:, ::-1]
    ones = np.concatenate([np.bincount(h[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "mark": b["mark"], "fp": made})


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Gray-ordered fingerprints under nodes that hold the bits shared by all below them."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        value, mask = codes[self.order], np.full(len(codes), _FULL)
        levels = [(value, mask)]
        while len(value) > FAN:
            at = np.arange(0, len(value), FAN)
            first = np.repeat(value[at], np.diff(np.append(at, len(value))))
            differ = np.bitwise_or.reduceat((value ^ first) | ~mask, at)
            mask = ~differ
            value = value[at] & mask
            levels.append((value, mask))
        self.levels = []
        above = None
        for value, mask in reversed(levels):  # bits that a parent holds are not counted again
            own = mask if above is None else mask & ~np.repeat(above, FAN)[: len(mask)]
            self.levels.append((value, own))
            above = mask
        self.size = len(codes)

    def within(self, queries: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """All (query, code) positions at a distance of ``near`` or less."""
        n = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        far = np.zeros(len(q), np.int64)
        for depth, (value, mask) in enumerate(self.levels):
            if depth:
                q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                keep = node < len(value)
                q, far, node = q[keep], far[keep], node[keep]
            far = far + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            keep = far <= near
            q, far, node = q[keep], far[keep], node[keep]
        return q, self.order[node]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def forest(codes: np.ndarray) -> np.ndarray:
    """For each code the first code of its group under links of ``NEAR`` bits or fewer."""
    parent, index = np.arange(len(codes)), GrayIndex(codes)
    for i in range(0, len(codes), 256):
        q, other = index.within(codes[i : i + 256])
        parent = _union(parent, q + i, other)
    return parent


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        u, v = [], []
        for members in b["members"]:
            fp = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
            rep = np.array([m["rep"] for m in members], np.int64)
            root = forest(fp)
            link = root != np.arange(len(root))
            u.append(rep[link])
            v.append(rep[root[link]])
        yield pd.DataFrame({"u": np.concatenate(u or [[]]).astype(np.int64), "v": np.concatenate(v or [[]]).astype(np.int64)})


def _dealt(codes: DataFrame, masks: list[int], mask: str, key: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias(mask), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias(key)) for i, m in enumerate(masks)))
    return codes.select("*", F.inline(each))


def links(codes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links ``(u, v)`` that join all fingerprints within ``NEAR`` bits; ``codes``: distinct fp and its name rep (bigint)."""
    dealt = _dealt(codes, MASKS, "m", "key")
    shared = dealt.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(shared, ["m", "key"])
    few = dealt.where(F.col("n") <= group).select("m", "key", F.lit(-1).alias("m2"), F.lit(0).cast("bigint").alias("key2"), "fp", "rep")
    many = dealt.where(F.col("n") > group)
    deals = [F.when(F.col("m") == i, F.array(*(F.struct(F.lit(j).alias("m2"), F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("key2")) for j, s in enumerate(subs)))) for i, subs in enumerate(SUBMASKS)]
    many = many.select("m", "key", F.inline(F.coalesce(*deals)), "fp", "rep").select("m", "key", "m2", "key2", "fp", "rep")
    groups = few.union(many).groupBy("m", "key", "m2", "key2").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
    return groups.where(F.size("members") > 1).select("members").mapInPandas(_forests, "u bigint, v bigint")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, mark (hash of the text), fp, root (a fingerprint that names the component) and
    least (its smallest id)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInPandas(_fingerprints, "doc_id bigint, mark bigint, fp bigint"), "fingerprints")
    codes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("own")), "codes")
    linked = components(links(codes.select("fp", F.col("fp").alias("rep")))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    codes = codes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = codes.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    codes = looked_up(codes, written(least, "components"), "root", "fp", small, "left").select("fp", "root", F.coalesce("least", "own").alias("least"))
    return rows.join(codes, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null texts and texts without words have fingerprint zero and link like any other. Repeated rows stay; ties do
    not arise, since a component is named by its smallest id. A row without an id has its fingerprint, links like
    any other, also between rows that have one, and takes their component; a component without any id is null.
    Texts of any length are read whole. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    return grouped(docs, id_col, text_col, small).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )
