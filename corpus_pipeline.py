"""From raw documents to packed training sequences: every stage is written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
their names and number. Null and empty texts, null ids, repeated rows, very long texts and empty tables are taken by each as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import scratch, table
from litspark.llm.exact_dedup import keep_one_of_each
from litspark.llm.mixing import apply_mix
from litspark.llm.near_dedup import keep_one_of_each_class
from litspark.llm.packing import pack_documents
from litspark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null and empty texts go, repeated rows are judged each, an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels").where(F.col("quality") == 1))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text but for the case of A-Z, the one of the largest id (null is the least): null and empty texts are one text."""
    return keep_one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the least id (null is the largest): of repeated rows one stays."""
    return keep_one_of_each_class(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 3 times: a null source is a source, documents without words are taken or not, at no cost."""
    return apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: each row is packed, an empty text as its end id alone, a long one over several sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: The quality ratio, the alignment and the rounding are no SQL: tests hold exact and near to brute force
#: and run() to the documents that quality keeps; mixed and packed are tested by their operators only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
