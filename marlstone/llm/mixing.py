"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are shares of a total by weight, capped at a number of epochs of what a source has; what is above the cap is
shared again. Blocks of equal token counts are allocated to sources by highest quotients (size over 1, 3, 5, ...),
then within a source to its shards. A shard lays its documents end to end in a seeded order, cuts them into blocks by
their first token, puts the blocks in a seeded order and takes documents from there until its quota is full, starting
over for a second epoch where the quota asks for it.

Shards have about ``shard_rows`` documents each, however many that makes, so a hot source is no single task; sources
and shards stay in distributed tables, and their blocks are small against a shard, so that quotas come near targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import looked_up, numbered, result, scope, words, written

WEIGHTS, TOTAL, EPOCHS = (5, 2, 1), 1.5, 2


def targets(sources: DataFrame, total: float = TOTAL, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (size, weight) with ``target``: shares of ``total`` times all sizes by weight, none above ``epochs``
    times its size.

    A target is the lesser of the cap and the weight times a common level. Each round finds the level for the
    sources not capped so far; those it caps stay capped, so there are few rounds, of one sum each.
    """
    level = None
    while True:
        capped = F.lit(False) if level is None else (F.lit(epochs) * F.col("size") <= F.lit(level) * F.col("weight"))
        sums = sources.where("size > 0").agg(
            F.sum("size").alias("all"),
            F.coalesce(F.sum(F.when(capped, F.lit(epochs) * F.col("size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weight"),
        )
        r = sums.first()
        left = total * (r["all"] or 0) - r["full"]
        now = left / r["weight"] if r["weight"] and left > 0 else 0.0 if level is None else level
        if level is not None and now <= level * (1 + 1e-12) or not r["all"] or not r["weight"]:
            break
        level = now
    level = level or 0.0
    return sources.withColumn("target", F.least(F.lit(float(epochs)) * F.col("size"), F.lit(float(level)) * F.col("weight")))


def apportion(table: DataFrame, groups: DataFrame, small: int) -> DataFrame:
    """``table`` (group, key, votes) with ``seats``, for ``groups`` (group, seats): by highest quotients
    votes / (2 k + 1), ties to the smaller key.

    With n parties every one is sure of the seats it has by rounding at n / 2 fewer seats than there are, and has no
    more than by rounding at n / 2 more; only the quotients between, at most two a party on average, are ranked.
    """
    with scope(table.sparkSession) as paths:
        return result(_apportioned(table, groups, small), "seats", paths)


def _apportioned(table: DataFrame, groups: DataFrame, small: int) -> DataFrame:
    total = table.groupBy("group").agg(F.sum("votes").alias("all"), F.count("*").alias("n"))
    total = written(total.join(groups, "group"), "parties")
    t = looked_up(table, total, "group", "key", small)

    def rounded(seats: str) -> str:
        return f"if(all > 0, cast(greatest(0, ceil(votes / all * ({seats}) - 0.5 {{0}} 1e-6 * (1 + seats))) as bigint), 0L)"

    sure, most = rounded("greatest(0, seats - n / 2D)").format("-"), rounded("seats + n / 2D").format("+")
    t = t.withColumns({"sure": F.expr(f"if(seats > 0, {sure}, 0L)"), "most": F.expr(f"if(seats > 0, {most} + 1, 0L)")})
    t = written(t, "sure")
    left = t.groupBy("group").agg((F.first("seats") - F.sum("sure")).alias("left"))
    quotients = t.where("most > sure and votes > 0").select("group", "key", F.expr("explode(sequence(sure, most - 1))").alias("k"), "votes")
    quotients = quotients.select("group", "key", (-F.col("votes") / (2 * F.col("k") + 1)).alias("order"))
    ranked = numbered(quotients, "group", "order", "key")
    firsts = ranked.groupBy("group").agg(F.min("rank").alias("first"))
    bounds = written(firsts.join(left, "group"), "bounds")
    won = looked_up(ranked, bounds, "group", "key", small).where("rank - first < left")
    won = won.groupBy("group", "key").agg(F.count("*").alias("more"))
    out = t.join(won, ["group", "key"], "left")
    return out.select("group", "key", "votes", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("seats"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, seed: int = 7, shard_rows: int = 2_000, shard_blocks: int = 200, small: int = 200_000, carry: bool = False) -> DataFrame:
    """One row per input row: id, ``size`` (words), ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    Sources in code-point order, null last, take ``weights`` in turn. Null and empty texts have size 0 and are
    never taken from; texts may be of any length. Repeated rows count as documents of their own; those that are
    equal in all that is read are interchangeable, and so are rows without an id that have the same text. The same
    input gives the same result whatever its partitions. An empty table gives no rows. Columns other than the three
    named are not read, whatever their names, but ``carry`` returns them in a struct ``row``.

    Tables of at most ``small`` rows of a few numbers are broadcast, larger ones joined over salted keys.
    """
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    # the code-point order of sources as a column of its own: null after all others
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("source"), F.size(words(F.col(text_col))).cast("bigint").alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("draw"), *row)
    rows = written(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sources = numbered(sources, "source", name="place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(targets(sources.withColumn("weight", weight), total, epochs), "sources")
    shards = F.expr(f"(n + {shard_rows - 1}) div {shard_rows}")
    sums = sources.agg(F.sum("target").alias("all"), F.sum(shards).alias("shards"), F.min(F.expr("if(target > 0, target, null)")).alias("least")).first()
    # small against a shard and against the smallest source
    block = max(1, int(min((sums["all"] or 0) / (sums["shards"] or 1), sums["least"] or 0) / shard_blocks))
    rows = looked_up(rows, sources.select("source", "place", F.col("size").alias("source_size"), "target", shards.alias("shards")), "source", "draw", small)
    rows = rows.withColumn("shard", F.pmod(F.hash("draw"), F.col("shards"))).drop("source", "shards")
    votes = sources.select(F.lit(0).cast("bigint").alias("group"), F.col("place").alias("key"), F.col("target").alias("votes"))
    every = votes.groupBy("group").agg(F.round(F.sum("votes") / block).cast("bigint").alias("seats"))
    seats = apportion(votes, every, small).select(F.col("key").alias("group"), "seats")
    sizes = rows.groupBy("place", "shard").agg(F.sum("size").alias("votes"))
    sizes = sizes.select(F.col("place").alias("group"), F.col("shard").cast("bigint").alias("key"), F.col("votes").cast("double").alias("votes"))
    quotas = apportion(sizes, seats, small).select(F.col("group").alias("place"), F.col("key").alias("shard"), (F.col("seats") * block).alias("quota"))
    rows = rows.join(quotas, ["place", "shard"])
    before = Window.unboundedPreceding, -1
    lying = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size")
    start = F.coalesce(F.sum("size").over(lying.rowsBetween(*before)), F.lit(0))
    rows = rows.withColumn("block", F.floor(start / F.lit(block)))
    turn = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed), "place", "shard", "block"), "block", "draw", "doc_id", "size").rowsBetween(*before)
    rows = rows.withColumns({"before": F.coalesce(F.sum("size").over(turn), F.lit(0)), "all": F.sum("size").over(Window.partitionBy("place", "shard"))})
    part = [F.least(F.col("size"), F.greatest(F.lit(0), F.col("quota") - F.col("all") * e - F.col("before"))) for e in range(epochs)]
    return rows.select("doc_id", "size", "source_size", "target", sum(part[1:], part[0]).cast("bigint").alias("taken"), *(["row"] if carry else []))
