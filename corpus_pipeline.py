"""Documents through five stages of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroflow.llm import decontamination, ngram_join, packing, quality_qda, toxicity
from hydroflow.llm.common import fold_is, scratch_path, table
from hydroflow.llm.queries import BATCH_TEXTS, LEAST_SCORE

#: No SQL: three stages are fitted models or learned patterns.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.keep(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), fold_is("doc_id", 3, 1)), LEAST_SCORE)


def low_quality_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go."""
    return quality_qda.keep(docs, table(spark, sf_dir, "labels"), fold_is("doc_id", 4, 2), LEAST_SCORE)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: that with the smallest id, whether ids are null or repeated or not."""
    return ngram_join.without_copies(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Rows are matched by a key of their own: ids may be null or repeated."""
    own = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text", F.struct(*docs.columns).alias("_row"))
    return decontamination.clean_documents(own, table(spark, sf_dir, "benchmark")).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _in_batches(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_TEXTS)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [("toxicity", _in_batches(toxic_out)), ("quality classifier", _in_batches(low_quality_out)),
          ("n-gram Jaccard join", _in_batches(copies_out)), ("benchmark decontamination", _in_batches(benchmark_out)),
          ("packing", _in_batches(packed))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
