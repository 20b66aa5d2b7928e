"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_compact(df: DataFrame, rows_per_file: int = 100_000, least_rows: int = 5_000) -> DataFrame:
    """As ``cut``, in files of ``rows_per_file`` rows at most; two a core, if they then hold ``least_rows`` or more.

    A shuffle of many partitions would else leave as many small files in the shared folder, and each file costs an
    executor two processes of its own where the folder is a local file system (Hadoop changes modes by ``chmod``). The
    rows are first worked out in their own partitions and held on the executors' disks; if one is lost meanwhile, they
    are worked out again.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    rows = held.count()
    files = max(1, -(-rows // rows_per_file), min(2 * df.sparkSession.sparkContext.defaultParallelism, rows // min(least_rows, rows_per_file)))
    out = cut(held.coalesce(files))
    held.unpersist()
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
