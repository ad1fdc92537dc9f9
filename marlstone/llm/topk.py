"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

A block of vectors is held as postings: for each dimension and impact level the positions of the vectors whose
component has that quantised size, and its sign. For a block of queries segments are read by descending impact,
``STEP`` levels at a time; reading one adds impact times the query's weight to its vectors' scores and to no other. A
segment is laid out as a matrix, by vector and dimension with zeros between, so that reading it is one product. What of
a vector is still unread (and the error of quantising) is known by its norm, so that the score plus and minus that
norm times the query's bounds the true one (Cauchy-Schwarz). A query stops reading once these bounds prove that
few vectors can be among its best; only those are rescored, exactly, in integers. Without such proof it reads all.

A block of vectors is indexed once for up to ``CHUNK`` blocks of queries; only the best k of each pair go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, written

K, SCALE, EVERY, LEVELS = 5, 256, 50, 32
ROWS, QUERIES, CHUNK = 8192, 256, 64
#: Levels read at a time, and queries that are tried before a proof for all.
STEP, TRIED = 2, 8
#: Rescoring costs less than reading on when only one vector in so many is still possible.
FEW = 4
_LONG, _HUGE = np.iinfo(np.int64), int(np.finfo(float).max)


class ImpactIndex:
    """Posting segments of a block of vectors (integers held as doubles), by descending impact level."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.top = float(np.abs(vectors).max(initial=0)) or 1.0
        rest = vectors / self.top
        level = np.minimum((np.abs(rest) * levels).astype(np.int64), levels - 1)
        self.level, self.impact = level.astype(np.int16), np.sign(rest) * (level + 0.5) / levels  # the middle of the level
        self.segments, self.read, self.size = [], 0, vectors.size
        for high in range(levels, 0, -STEP):
            low = max(0, high - STEP)
            values = self._values(low, high)
            rest -= values
            if (n := np.count_nonzero((self.level >= low) & (self.level < high))) or low == 0:
                self.segments.append((low, high, n, np.sqrt((rest * rest).sum(1))))

    def _values(self, low: int, high: int) -> np.ndarray:
        return np.where((self.level >= low) & (self.level < high), self.impact, 0.0)

    def best(self, query_rows: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, ...]:
        """(query position, vec_id, score, score as double) of each query's k best rows but its own; ties to smaller ids."""
        n, found = len(self.ids), []
        top = np.maximum(np.abs(queries).max(axis=1, initial=0), 1.0)
        weight = queries / top[:, None]
        norm = np.sqrt((weight * weight).sum(1))
        score, open_ = np.zeros((len(queries), n)), np.arange(len(queries))
        own = query_rows[:, None] == self.rows[None, :]
        few = max(4 * k, n // FEW)

        def possible(at: np.ndarray, score: np.ndarray, rest: np.ndarray) -> np.ndarray:
            slack = np.outer(norm[at], rest) * (1 + 1e-9) + 1e-9 * (1 + norm[at][:, None])
            out = ~own[at]
            if n > k:
                low = np.where(out, score - slack, -np.inf)
                out &= score + slack >= np.partition(low, n - k, axis=1)[:, n - k, None]
            return out

        for low, high, held, rest in self.segments:
            if not open_.size:
                break
            score += weight[open_] @ self._values(low, high).T
            self.read += held * open_.size
            final = low == 0
            if not final and not (possible(open_[:TRIED], score[:TRIED], rest).sum(1) <= few).any():
                continue
            left = possible(open_, score, rest)
            done = left.sum(1) <= few
            found += [(q, np.nonzero(left[i])[0]) for i, q in enumerate(open_) if done[i]]
            if final:
                last = left[~done]
            open_, score = open_[~done], score[~done]
        if open_.size:  # no proof for few: all that are still possible
            found += [(q, np.nonzero(last[i])[0]) for i, q in enumerate(open_)]
        out = [(q, *self._exact(queries[q], at, k)) for q, at in found]
        return tuple(np.concatenate(x) for x in zip(*((np.full(len(i), q), i, s, near) for q, i, s, near in out), strict=True)) if out else (np.zeros(0, np.int64),) * 4

    def _exact(self, query: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most = self.top * np.abs(query).max(initial=0) * max(1, len(query))
        if most < 2.0**62:
            # below 2^53 doubles hold every sum of integers exactly
            score = (self.vectors[at] @ query).astype(np.int64) if most < 2.0**53 else self.vectors[at].astype(np.int64) @ query.astype(np.int64)
            first = np.lexsort((self.ids[at], -score))[:k]
            return self.ids[at][first], score[first], score[first].astype(float)
        wide = [int(x) for x in query]  # integers of any size
        scores = [sum(int(x) * y for x, y in zip(v, wide, strict=True)) for v in self.vectors[at]]
        first = sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k]
        return self.ids[at][first], np.array([min(max(scores[i], _LONG.min), _LONG.max) for i in first], np.int64), np.array([min(max(scores[i], -_HUGE), _HUGE) for i in first], float)


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    with np.errstate(over="ignore"):
        vectors = np.nan_to_num(np.floor(SCALE * np.array(rows["v"].tolist(), "<f8").reshape(len(rows), -1)))
    return pd.DataFrame({"dim": [vectors.shape[1]], "block": [rows["block"].iloc[0]], "rows": [rows["row"].to_numpy("<i8").tobytes()], "ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "data": [vectors.tobytes()]})


def _read(rows: bytes, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return np.frombuffer(rows, "<i8"), i, np.frombuffer(data, "<f8").reshape(len(i), -1)


def _searcher(k: int):
    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in data.itertuples():  # one block
            index = ImpactIndex(*_read(b.rows, b.ids, b.data))
            for r in asked.itertuples():
                query_rows, query_ids, queries = _read(r.rows, r.ids, r.data)
                before = index.read
                q, vec, score, near = index.best(query_rows, queries, k)
                out.append(pd.DataFrame({"query_row": query_rows[q], "query_id": query_ids[q], "vec_id": vec, "score": score, "near": near, "unread": 1 - (index.read - before) / max(1, index.size * len(queries))}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": [], "near": [], "unread": []})

    return search


def searched(vectors: DataFrame, id_col: str, vector_col: str, every: int, k: int, rows: int, queries: int) -> DataFrame:
    """The best k of each query in each block, with the share of the block's postings left ``unread``."""
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    v = vectors.where(F.col(id_col).isNotNull() & sound)
    v = v.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"), F.size(vector_col).alias("dim"), x.alias("v"))
    v = written(v, "vectors")
    n = v.agg(F.count("*"), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("int")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-n[0] // rows)), max(1, -(-n[1] // queries))

    def packed(d: DataFrame, parts: int) -> DataFrame:
        d = d.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
        return d.groupBy("dim", "block").applyInPandas(_packed, "dim int, block int, rows binary, ids binary, data binary")

    data = written(packed(v, blocks), "blocks").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((query_blocks - 1) // CHUNK))))
    asked = packed(v.where(F.col("vec_id") % every == 0), query_blocks).withColumn("chunk", F.expr(f"block div {CHUNK}").cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "block", "chunk"]
    return data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_searcher(k), "query_row bigint, query_id bigint, vec_id bigint, score bigint, near double, unread double")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every`` the k best other rows.

    Components become ``floor(256 x)``. Vectors that are null or hold a null or non-finite component take no part,
    as query or candidate; so do rows without an id. Only vectors of the query's length are candidates; empty
    vectors have the score 0. Components may be of any size: scores are exact integers, given as the nearest
    ``bigint`` where they exceed it. A vector may be of any length. Each row counts for itself: rows that repeat
    an id or a vector are candidates as often as they occur, and a query that occurs twice is answered twice. Ties
    go to the smaller id. An empty table, or one without queries, gives no rows. Other columns are not read.
    """
    best = Window.partitionBy("query_row").orderBy(F.desc("near"), F.desc("score"), "vec_id")  # beyond a bigint, the doubles order
    found = searched(vectors, id_col, vector_col, every, k, rows, queries)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
