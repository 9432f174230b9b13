"""From raw documents to packed training sequences.

Every row is a document. ``doc_id`` is its identity from the first stage on, which gives rows without one,
and all but one of the rows that repeat one, numbers above the largest in use. The second stage alone, on a table
that has not been through the first, still drops rows without an id and keeps one row for each id. Columns other than
those named below are carried along. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.mixing import mixed_documents
from wayfield.llm.neardup import near_duplicates
from wayfield.llm.packing import TOKENIZER, pack_documents
from wayfield.llm.quality import GOOD, learn_quality, score_quality
from wayfield.llm.shared import running_sum, table
from wayfield.llm.suffixes import without_repeats
from wayfield.sources.scratch import Scratch, scratch_root


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``doc_id`` of its own for each row; of rows with the same, the first by its text's hash keeps it."""
    known = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    scratch = Scratch(docs.sparkSession, "identities")
    shared = scratch.save(known.where("doc_id IS NULL OR rows > 1").select(F.col("doc_id").alias("__shared")), "shared")
    if shared.isEmpty():
        return docs
    is_shared = F.col("doc_id") == F.col("__shared")
    alone = docs.where("doc_id IS NOT NULL").join(shared, is_shared, "left_anti")
    # Written once, so that a row keeps its number.
    several = scratch.save(docs.where("doc_id IS NOT NULL").join(shared, is_shared, "left_semi").unionByName(docs.where("doc_id IS NULL"))
                           .withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id()), "several")
    numbered = running_sum(several.select("doc_id", "__hash", "__row", F.lit(1).alias("__one")), [], ["doc_id", "__hash", "__row"], "__one", scratch, "__number")
    numbered = scratch.save(numbered.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__at"), "__number"), "numbered")
    first = numbered.where("__id IS NOT NULL").groupBy("__id").agg(F.min("__number").alias("__number")).select("__number", F.col("__id").alias("__kept"))
    above = F.lit((docs.agg(F.max("doc_id")).first()[0] or 0) + 1)
    own = numbered.join(first, "__number", "left").select("__at", F.coalesce("__kept", above + F.col("__number")).cast(docs.schema["doc_id"].dataType).alias("__own"))
    renamed = several.join(own, F.col("__row") == F.col("__at")).withColumn("doc_id", F.col("__own"))
    return alone.unionByName(renamed.select(*docs.columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees do not reject, all if there was no label to learn from; each with an id of its own."""
    trees = learn_quality(docs, table(spark, sf_dir, "labels"))
    own = identified(docs)
    if not trees.labels:
        return own
    return score_quality(own, trees, "__score").where(F.col("__score") >= GOOD).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, similarity 0.8).

    Rows without an id of their own get one, so that no row goes but for its own text.
    """
    docs = identified(docs)
    kept = near_duplicates(docs, words=5, similarity=(80, 100)).where("kept").select(F.col("doc_id").alias("__doc"))
    return docs.join(kept, F.col("doc_id") == F.col("__doc"), "left_semi").select(*docs.columns)


def unrepeated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document with a smaller id has; gone if that was all they had."""
    has_words = r"[^\x20\x09-\x0D]"
    cut = without_repeats(docs.withColumn("__had", F.coalesce(F.col("text").rlike(has_words), F.lit(False))))
    left = cut.where(~F.col("__had") | F.col("text").rlike(has_words)).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else left


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last one of a source as far, as the sources' target weights ask for."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of at most 4096."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", good_documents), ("near_duplicates", distinct_documents), ("repeats", unrepeated_documents), ("mix", mixed), ("pack", packed)]

# The trees' scores can't be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    path = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{i}-{name}")
        docs = spark.read.parquet(f"{path}/{i}-{name}")
    return docs
