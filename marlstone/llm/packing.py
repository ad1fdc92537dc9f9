"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids and an end id are cut into full sequences and one shorter rest. The histogram of rest
lengths, rounded up to a grid of a few ids, is a cutting-stock problem (at most ``capacity / grid`` numbers,
whatever the corpus): a linear program over patterns, whose columns are priced by knapsack dynamic
programming. Pattern counts are rounded down; the few rests left over are placed best-fit. Rests are then
numbered by size class, in ranges that are sorted apart, and take the slots of the patterns in order, by a join
with a table of slot ranges; they move together within their sequence, so that only its end is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import numbered, small_batches, written
from marlstone.llm.tokens import VOCABULARY, token_ids

CAPACITY, END, GRID = 1024, 0, 4
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cutter(capacity: int, vocabulary: str, end: int, carry: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(token_ids(text, vocabulary), np.array([end], "<u4")).astype("<u4")
                raw = ids.tobytes()
                for at in range(0, len(ids), capacity):
                    size = min(capacity, len(ids) - at)
                    own = raw[4 * at : 4 * (at + size)]
                    out.append((doc, at, size, zlib.crc32(own), len(ids), *([own] if carry else [])))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if carry else [])]).astype({"doc_id": "Int64"})

    return cut


def _knapsack(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of lengths 1..capacity with total length within capacity: value, copies by length."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = best[c - 1 :: -1][:c] + price[1 : c + 1]
        i = int(value.argmax())
        best[c], take[c] = (value[i], i + 1) if value[i] > best[c - 1] else (best[c - 1], 0)
    copies, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if take[c]:
            copies[take[c]] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), copies


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product without BLAS, whose threads stall where the driver shares its cores."""
    return np.einsum("ij,j->i", matrix, vector)


def patterns(counts: np.ndarray, capacity: int = CAPACITY, gap: float = 2e-3, rounds: int = 3000) -> list[tuple[int, np.ndarray]]:
    """Column generation over a histogram of lengths: (times, copies by length), covering every item exactly.

    Simplex on the restricted master with an explicit inverse. Columns of a best-fit packing enter first;
    then the knapsack prices new ones, at duals smoothed toward those of the best bound so far, until the
    bound is within ``gap`` or ``rounds`` are over. Either way every item is placed.
    """
    lengths = np.nonzero(counts)[0]
    m = len(lengths)
    if not m:
        return []
    need = counts[lengths].astype(float)
    # start: each length alone, as many copies as fit; the basis is diagonal
    columns = np.diag((capacity // lengths).astype(float))
    inverse, level = np.diag(1.0 / np.diag(columns)), need / np.diag(columns)
    greedy = _best_fit(counts.astype(np.int64), capacity)
    pool = np.unique([copies[lengths] for _, copies in greedy], axis=0).astype(float)
    bound, center = 0.0, inverse.sum(0)
    for _ in range(rounds):
        dual = inverse.sum(0)  # every pattern costs one sequence
        worth = _times(pool, dual)
        column = pool[worth.argmax()]
        if worth.max() <= 1 + 1e-4:
            for smooth in (0.7, 0.0):
                price = np.full(capacity + 1, -1.0)
                at = smooth * center + (1 - smooth) * dual
                price[lengths] = np.maximum(at, 0)
                best, copies = _knapsack(price, capacity)
                if (lower := (price[lengths] @ need) / max(best, 1e-12)) > bound:
                    bound, center = lower, price[lengths] / max(best, 1e-12)
                column = copies[lengths].astype(float)
                if column @ dual > 1 + 1e-7:
                    break
            if column @ dual <= 1 + 1e-7 or level.sum() - bound <= gap * level.sum():
                break
            pool = np.vstack([pool, column])
        move = _times(inverse, column)
        ratio = np.where(move > 1e-9, level / np.maximum(move, 1e-9), np.inf)
        out = int(ratio.argmin())
        level = np.maximum(level - ratio[out] * move, 0)
        level[out] = ratio[out]
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        columns[out] = column
    left, chosen = counts.astype(np.int64).copy(), []
    for i in np.argsort(-level, kind="stable"):
        copies = np.zeros(capacity + 1, np.int64)
        copies[lengths] = columns[i].astype(np.int64)
        used = copies > 0
        times = int(min(np.floor(level[i] + 1e-9), (left[used] // copies[used]).min()))
        if times > 0:
            left -= times * copies
            chosen.append((times, copies))
    return chosen + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Place what rounding left, longest first, each filled up by the longest that fit."""
    left, chosen = left.copy(), []
    while left.any():
        copies, room = np.zeros(capacity + 1, np.int64), capacity
        while room > 0 and (fit := np.nonzero(left[: room + 1])[0]).size:
            n = int(fit[-1])
            k = int(min(left[n], room // n))
            copies[n] += k
            left[n] -= k
            room -= n * k
        again = int((left[copies > 0] // copies[copies > 0]).min())
        left -= again * copies
        chosen.append((1 + again, copies))
    return chosen


def _slots(chosen: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges of ranks by length: length, first rank, past last, first sequence, copies, offset in a sequence."""
    seen, sequence, out = {}, 0, []
    for times, copies in chosen:
        offset = 0
        for n in np.nonzero(copies)[0][::-1].tolist():
            k = int(copies[n])
            low = seen.get(n, 0)
            out.append((n, low, low + times * k, sequence, k, offset))
            seen[n], offset = low + times * k, offset + n * k
        sequence += times
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, grid: int = GRID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``ids`` the piece's
    ids too (little-endian unsigned 32-bit), which ``sequences`` puts together.

    A null or empty text is the end id alone. Repeated rows are packed each for itself; pieces that tie in all that
    is read are interchangeable. Rows without an id are packed with a null one. Texts of any length are read whole.
    An empty table gives no pieces. Sequences are filled from offset 0 without gaps; what a sequence lacks to
    ``capacity`` is padding. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = written(rows.mapInPandas(_cutter(capacity, vocabulary, end, ids), PIECES + (", ids binary" if ids else "")), "pieces")
    cut = cut.withColumn("class", F.ceil(F.col("length") / grid).cast("int"))
    whole = capacity // grid
    histogram = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}  # at most capacity / grid rows
    top = histogram.pop(whole, 0)
    counts = np.zeros(whole + 1, np.int64)
    counts[list(histogram)] = list(histogram.values())
    slots = [(whole, 0, top, 0, 1, 0)] + [(n, lo, hi, s + top, k, o) for n, lo, hi, s, k, o in _slots(patterns(counts, whole))]
    schema = "class int, low bigint, high bigint, sequence bigint, copies bigint, at bigint"
    table = F.broadcast(spark.createDataFrame(slots, schema))  # a few ranges for each size class
    sizes = np.append(counts, 0)
    sizes[whole] = top
    firsts = spark.createDataFrame([(n, int(f)) for n, f in enumerate(np.cumsum(sizes) - sizes)], "class int, first bigint")
    cut = cut.withColumn("draw", F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = numbered(cut, "class", "draw", "doc_id", "start").join(F.broadcast(firsts), "class")  # one row a size class
    ranked = ranked.withColumn("rank", F.col("rank") - F.col("first"))
    placed = ranked.join(table, "class").where("rank >= low and rank < high")
    nth = F.col("rank") - F.col("low")
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else []),
        (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("copies")) * F.col("class")).alias("slot"),
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = END) -> DataFrame:
    """One row per sequence of ``pack(..., ids=True)``: sequence_id, n_pieces, n_ids, ids (padded to ``capacity``).

    A sequence has at most ``capacity`` pieces, so none outgrows a task.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    d = pieces.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("n_ids"), held.alias("held"))
    fill = F.repeat(F.hex(F.lit(int(pad).to_bytes(4, "little"))), (F.lit(capacity) - F.col("n_ids")).cast("int"))
    return d.select("sequence_id", "n_pieces", "n_ids", F.concat(whole, F.unhex(fill)).alias("ids"))
