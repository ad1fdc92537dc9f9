"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all that its predecessor
kept. All but the last return the columns of ``documents``. ``run`` writes each stage as Parquet to the shared
folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import common, lines, mixing, packing, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and with them null and empty texts.

    Rows without an id, source or language are judged like any other; rows that repeat one another go or stay
    together. An empty table gives no rows. Columns besides those of ``documents`` go.
    """
    return quality.quality(docs, carry=True).where("kept").select("row.*").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents stay in the document with the smallest id only.

    No document goes; one that loses all its lines has an empty text. Null texts stay null. Rows without an id count
    as one document that comes last. An empty table gives no rows. Columns besides those of ``documents`` go.
    """
    return _counted(lines.drop_recurring_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, and of several texts with that id the one of the
    smallest hash. A group of rows without an id keeps one of them.

    Null and empty texts have one fingerprint and so are one group. Of rows that repeat id and text one stays. An
    empty table gives no rows. Columns besides those of ``documents`` go.
    """
    found = simhash.grouped(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("first_id"), F.col("f.mark").alias("mark"))
    d = docs.select(*COLUMNS).withColumn("own", F.xxhash64("text"))
    kept = d.join(first, d["doc_id"].eqNullSafe(first["first_id"]) & (d["own"] == first["mark"]))
    one = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy(F.xxhash64("text", "lang", "source", "n_chars")))
    return kept.withColumn("one", one).where("one = 1").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a shard's edge gives only the words taken.

    Documents without a word are never taken, and so go. Rows without an id or source are mixed like any other, rows
    that repeat one another each for itself. An empty table gives no rows. Columns besides those of ``documents`` go.
    """
    d = mixing.mix(docs.select(*COLUMNS), carry=True).where("taken > 0").select("size", "taken", "row.*")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    cut = F.array_join(F.slice(common.words(F.col("text")), F.lit(1), rest), " ")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return _counted(d.withColumn("text", F.explode(copies)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids.

    A null or empty text is one end id. Rows without an id are packed with a null one, repeated rows each for itself.
    An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, column generation and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``. Of a stage only its result stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with common.scope(spark) as paths:
            docs = common.result(stage(spark, docs, sf_dir), name.replace(" ", "-"), paths)
    return STAGES[-1][1](spark, docs, sf_dir)
