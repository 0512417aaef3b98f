"""Cleaning and packing of a document corpus in five stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``:

1. ``language_id`` drops documents without a letter, without text, or unlike every
   language learned from the corpus.
2. ``near_dedup`` keeps one row of each group of near-duplicates (five-word shingles,
   similarity 0.8): the one with the smallest id, null ids last.
3. ``decontaminate`` drops documents of which a twentieth or more of the words lie
   in benchmark passages.
4. ``secret_scan`` replaces secrets, encoded ones too, by a mark in the text.
5. ``pack`` cuts what is left into pieces and packs them into sequences.

Every row is judged by itself: the second and third stage number the rows they are
given, so rows without an id, or texts that share one, are neither passed over nor
lost with each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm.decontamination import contamination
from tillwork.llm.hyperminhash import near_duplicates
from tillwork.llm.language_id import known_language, learn_languages
from tillwork.llm.packing import cut_documents, pack
from tillwork.llm.secret_scan import redacted
from tillwork.sources.scratch import materialise, new_path, settled

# None: SQL can state neither the hyperdimensional profiles nor the tokenizer.
ORACLE_SQL: str | None = None

# Rows travel to Python and back whole, and writers hold a row group each; these bound what is
# in memory at a time.
BATCH_BYTES = "4m"
ROW_GROUP_BYTES = str(32 << 20)
ROW = "_row"


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("parquet.block.size", ROW_GROUP_BYTES)


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with a number each, written so that it stays."""
    path = new_path(spark, "numbered")
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _judged(rows: DataFrame) -> DataFrame:
    """Number and text, the number in the place of the id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return known_language(docs, learn_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    rows = _numbered(spark, docs)
    found = settled(lambda: near_duplicates(_judged(rows)).select(
        F.col("doc_id").alias(ROW), "component_id"), "groups")
    # One row of each group; the join is by row, so a large group is spread like any rows.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW]
    best = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first.alias(ROW)).select(ROW)
    return rows.join(best, ROW, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    rows = _numbered(spark, docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = settled(lambda: contamination(_judged(rows), benchmark).where("contaminated").select(
        F.col("doc_id").alias(ROW)), "dirty")
    return rows.join(dirty, ROW, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return pack(cut_documents(docs)).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
