"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents:

1. ``quality``: documents that the quality classifier rejects go;
2. ``near_duplicates``: one document of each group of linked documents stays;
3. ``decontaminate``: documents that hold a benchmark item go;
4. ``personal_data``: personal data in texts is replaced by its kind in brackets;
5. ``tokens``: documents become subword ids, checked by decoding.

All stages but the last return the columns of ``documents``, more columns than
those included, whatever their names.

Defined results: documents with null or empty texts are judged by the score of
the empty text, are nobody's near copy and hold no benchmark item, and keep their
null through the fourth stage; the last gives them no ids.  Without labels every
score is 0.5, which the first stage rejects; with labels of one kind it is that
kind.  Rows of one doc_id with one text stay together through the second stage;
documents without doc_id are judged by their text, and are never copies or leaks.
Empty tables give empty results.  Whole texts are read, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, pii, quality, sentencepiece_codec
from tessera.llm.common import documents, remove, scratch, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the ids, their number, and whether they decode to the text."""
    return sentencepiece_codec.encode(docs, out="ids", check="round_trip", memo_parts=TOKEN_MEMO).select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


#: Parts that a worker of the last stage remembers: fewer than alone, as the executors' heaps have grown by then.
TOKEN_MEMO = 150_000

STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: SQL expresses neither the classifier nor the random field; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written to the shared folder and read again.

    What a stage has read and the tables it has written on the way are removed when its result is written.
    """
    docs, before = documents(spark, sf_dir), None
    folder = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
