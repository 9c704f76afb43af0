"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, mixing to target weights.

Each stage works on all rows its predecessor kept, and returns the columns of documents; the last adds domain,
n_tokens and copies. Extra columns are carried along. Rows with null doc_id pass the filters and are not mixed; a null
text goes with the first stage; rows that share a doc_id stay if one of them does; an empty table stays empty."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, language_id, line_dedup, minhash_dedup, mixing
from larkspur.llm.common import fold, mark, release, remove, scratch_dir, table, unused
from larkspur.llm.queries import MIX_EPOCHS, MIX_SHARE, MIX_WEIGHTS

#: A document is rejected if its language cannot be told at all, or with less than this calibrated probability.
MIN_LANGUAGE_SCORE = 0.5


def _only(docs: DataFrame, decisions: DataFrame, rule: F.Column) -> DataFrame:
    """The rows of docs whose doc_id some row of decisions accepts; null doc_ids stay."""
    key = unused(docs, "good_id")
    good = decisions.where(rule & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct()
    kept = docs.where("doc_id is not null").join(good, F.col("doc_id") == F.col(key), "left_semi")
    return kept.union(docs.where("doc_id is null"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some confidence; null and letterless texts go."""
    model = language_id.fit(docs, fold("doc_id", 4) != 2)
    return _only(docs, language_id.identify(docs, model), (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without line chunks that an earlier place has."""
    return line_dedup.remove_repeated_chunks(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates; five words, similarity 0.8."""
    return _only(docs, minhash_dedup.near_duplicates(docs, width=5, percent=80), F.col("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or little of one."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _only(docs, found, ~F.col("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The selection of documents that meets the target weights within the budget."""
    return mixing.mix(docs, MIX_SHARE, MIX_EPOCHS, weights=MIX_WEIGHTS)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The trained language model and the seeded trees and sketches have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written as Parquet in the shared folder and read again. A stage's intermediate
    tables and its predecessor's result are deleted once its own result is written."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        release(since)
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
    return docs
