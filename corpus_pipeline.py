"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
keep the columns of ``documents``; the last adds token ids and the decoded text.

In every stage: other columns than those of ``documents`` are not carried on
and cannot clash; an empty table gives an empty one; long texts are taken whole.
Stages that use Python lower the session's Arrow batches from Spark's default of
64 MB to 2 MB, so that a batch of long texts does not fill an executor; they stay
low for the caller, who runs what a stage returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.llm import line_dedup, mixture, ngram_join, quality, sentencepiece
from oremill.llm.tables import ensure_checkpoints, fanout, read, small_batches, temporary, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, gives a score of 0.5 or more.

    Null and blank texts are scored as texts without words, null ids like any
    other; equal rows share one fate; without labels every document stays.
    """
    small_batches(spark)
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated multi-line chunks; documents of which nothing is left go.

    A null or empty text has nothing to remove and stays; rows with a null id
    stay as they are; equal rows keep or lose the same chunks. ``n_chars`` is
    counted anew where lines went.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed_lines") > 0) & (F.col("n_removed_lines") == F.col("n_lines"))
    return out.where(~emptied).withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group with a five-word similarity of 0.8 or more.

    Null and blank texts are similar to nothing and stay, and so do rows with a
    null id; rows that share an id are one document and stay or go together.
    """
    small_batches(spark)
    groups = ngram_join.join_ngrams(docs, n=5, percent=80)
    dropped = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Documents without words are taken no time, so they go; null sources are
    one source; equal rows are taken on their own account.
    """
    mixed = mixture.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    return mixture.training_order(mixed, fanout(docs)).select(*COLUMNS)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to; null texts have null ids."""
    small_batches(spark)
    return sentencepiece.round_trip(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram jaccard join", ngram_join_stage),
    ("mixing to target weights", mixing),
    ("sentencepiece", sentencepiece_ids),
]

#: A trained network decides the first stage; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the cluster's shared folder.

    A stage's checkpoints go when it is written, its own table when the next
    stage is; the last stage's input stays, as the result reads it.
    """
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with temporary():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return STAGES[-1][1](spark, docs, sf_dir)
