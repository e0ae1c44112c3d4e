"""A training-data pipeline: each stage reads what the one before it wrote.

Stages but the last return the columns of documents.  What depends on the text
alone (language, contamination) is decided row by row, whatever the doc_id; the
dedup stages know rows by a key of their own where doc_ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisloom.llm.decontamination import decontaminate
from basisloom.llm.exact_dedup import equal_text_classes
from basisloom.llm.language_id import UNKNOWN, fit, held_out, identify
from basisloom.llm.ngram_join import similarity_classes
from basisloom.llm.packing import best_fit_pack, encode_pieces
from basisloom.llm.scratch import BROADCAST_ROWS, Scratch

#: A document whose best language has less probability than this is rejected.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text in one struct, whose names clash with none that an operator makes."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("document"))


def _documents(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("document").getField(c).alias(c) for c in columns))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """``_carried(docs)`` with a key of the row, _key, that goes by doc_id, a null one last.

    It is the doc_id itself where no row repeats one and none is null; otherwise
    a number of the sorted rows, which are written once so that it stays.  Texts
    and row numbers take part in the sort, so that a hot id is no single task.
    """
    doc_id, rows = F.col("doc_id").cast("long"), _carried(docs)
    if docs.groupBy(doc_id.alias("id")).count().where("count > 1 OR id IS NULL").isEmpty():
        return rows.withColumn("_key", doc_id)
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).sort(doc_id.asc_nulls_last(), F.xxhash64("text"), "_row")
    return Scratch(docs.sparkSession, f"{name}-rows").write(rows.drop("_row").withColumn("_key", F.monotonically_increasing_id()), "keyed")


def _without(spark: SparkSession, docs: DataFrame, dropped: Callable[[DataFrame, Scratch], DataFrame], name: str) -> DataFrame:
    """``docs`` without the rows that ``dropped`` names, which sees keys of rows in place of doc_ids.

    The keys are written first and what they were made from is deleted; they are
    broadcast if they are few, and shuffled otherwise.
    """
    work, keyed = Scratch(spark, f"{name}-work"), _keyed(docs, name)
    rows = keyed.select(F.col("_key").alias("doc_id"), "text")
    keys = Scratch(spark, name).write(dropped(rows, work).select(F.col("doc_id").alias("_dropped")), "dropped")
    work.clear()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return _documents(keyed.join(keys, F.col("_key") == F.col("_dropped"), "left_anti"), docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language that is likelier than all others together."""
    model = fit(docs.where(~held_out(F.col("doc_id").cast("long"))))
    rows = identify(_carried(docs).drop("doc_id"), model)
    return _documents(rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one with the smallest doc_id stays (a null one is the largest)."""
    return _without(spark, docs, lambda rows, work: equal_text_classes(rows, scratch=work).where("NOT kept"), "exact_dedup")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows with similar texts one with the smallest doc_id stays (a null one is the largest)."""
    return _without(spark, docs, lambda rows, work: similarity_classes(rows, scratch=work).where("component_id != doc_id"), "ngram_join")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages to the contamination rule go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = decontaminate(_carried(docs), benchmark, carry=("text", "document"))
    return _documents(rows.where("NOT contaminated"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 ids."""
    pieces = encode_pieces(docs, capacity=2048, end_id=0)
    return best_fit_pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Language models and similarity groups are not expressible in SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
