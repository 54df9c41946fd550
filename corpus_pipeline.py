"""From raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm import cleaning, near_dup, packing, pii
from fairline.llm.queries import WORD_BPE, quality_scores, read
from fairline.session import stage

SIZE = 2048


def with_text(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. The verdict is joined by document, so documents that share an id stand or fall together, by the best."""
    scored = quality_scores(docs, read(spark, sf_dir, "labels"))
    bad = scored.groupBy("doc_id").agg(F.max("predicted").alias("predicted")).where("predicted = 0").select(F.col("doc_id").alias("bad_id"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that fail."""
    return with_text(cleaning.keep(docs, "text"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.keep_one(docs, "doc_id")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return with_text(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of ``SIZE`` tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), SIZE, "doc_id")


STAGES = [("quality classifier", classify), ("quality rules", clean_lines), ("near copies", drop_copies), ("personal data", redact),
          ("packing", pack)]

#: The classifier and the sampler can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
