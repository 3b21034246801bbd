"""A corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

Every stage but the last returns the columns of documents; the last adds copy, the number of the copy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm.common import drop_folder, scratch, shared_dir, table
from cartolith.llm.decontaminate import decontaminate
from cartolith.llm.jaccard_join import one_of_each
from cartolith.llm.mixing import mixed_documents
from cartolith.llm.pii import redact
from cartolith.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, toxic ones among them."""
    return good_documents(docs, table(spark, sf_dir, "labels"), toxic=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words a shingle, similarity of 0.8 or more."""
    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by their copies in the mix."""
    return mixed_documents(docs, weights=(5, 2, 1), budget=1.5, cap=2)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]
#: Not expressible in SQL; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents. Tables that a stage made go when it has been written, each stage's rows when the next has read them."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}-{name}")
        if number:
            drop_folder(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
