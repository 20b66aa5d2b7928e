"""Cut lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of short rows is sent to all tasks.
FEW = 20_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (tests), a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.getConf().get("spark.checkpoint.dir") and not re.match(r"local($|\[)", sc.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame) -> DataFrame:
    """``df`` (short rows, materialised before), sent to all tasks by joins if it has at most ``FEW`` rows; so what it is joined with is not shuffled."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
