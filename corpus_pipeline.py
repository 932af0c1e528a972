"""A training corpus from ``documents`` in four stages, each by one operator of tarnfold.llm.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of ``documents``. Stages are written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import bpe, jaccard, mixing, toxicity
from tarnfold.session import checkpoint_dir, remove


#: Rows that a Python worker is handed at once: long texts and their copies in JVM and worker stay few.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Classifier chain fitted on the labels; documents at or over the toxic threshold go.

    Null and empty texts are judged by the models' base probability and stay; very long texts are read whole; repeated rows
    stay or go together; an empty table, or one without labels, loses nothing; all columns come back as they were.
    """
    _small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxicity.label_table(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8 or more: of each group the document of the smallest id stays.

    Null, empty and blank texts and rows without an id are linked with nothing and stay; rows of one id stay or go together;
    very long texts are compared whole; an empty table stays empty; all columns come back as they were.
    """
    _small_batches(spark)
    return jaccard.keep_one(docs, size=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing of sources to 95 % of the largest entropy, at most 4 passes of a source: documents repeat, or
    stay away, as their source's weight asks.

    A null source counts as the source ''; null or blank texts weigh nothing and pass as their place in the order says; a
    repeated row takes its place twice; ties of place go by the text's hash; an empty table stays empty; all columns come
    back as they were.
    """
    return mixing.realise(docs, target_entropy=0.95, max_repeats=4.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text. The workers keep what they remember while later stages run, so
    it is less here than where BPE runs alone.

    A null text counts as empty: no ids; repeated rows come back each; whole texts, however long; an empty table gives no
    rows; other columns are left out.
    """
    _small_batches(spark)
    return bpe.digests(docs, bpe.word_vocabulary(), cache=100_000)


STAGES = [("toxicity", reject_toxic), ("jaccard_join", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

# A fitted classifier and tokenisation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")  # nothing reads it any more
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
