"""A keyed table in hashed buckets, of which a batch rewrites those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, batch long"


class BucketStore:
    """``path``/data/batch=B/bucket=K holds what batch B left in bucket K; ``path``/manifest/B names the batch of each bucket.

    Batches are numbered on from 0, as Structured Streaming does. A batch reads the buckets that its rows fall into, and writes
    these and its manifest (``buckets`` lines at most); all others stay as they are. Its input is the manifest of the batch before, so a
    batch that is tried again gives the same files. An older snapshot can be read by its number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifest(self, batch: int) -> dict[int, int]:
        if batch < 0:
            return {}
        return {r.bucket: r.batch for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{batch}").collect()}

    def merge(self, batch: int, rows: DataFrame, key: Column, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame | None:
        """Fold ``rows`` into the table: ``fold(old, rows)`` gets the touched buckets' rows (None: no old ones) and gives the new ones.

        Returns the new rows as written, with their bucket; None if there are no ``rows``. ``key`` must be a key of the new rows, too.
        """
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        held = self.manifest(batch - 1)
        touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())
        out = None
        if touched:
            old = self._read({b: held[b] for b in touched if b in held})
            target = f"{self.path}/data/batch={batch}"
            new = fold(old, rows).withColumn("bucket", bucket)
            new.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(target)
            out = self.spark.read.schema(new.schema).parquet(target)
        lines = sorted((held | dict.fromkeys(touched, batch)).items())
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
        return out

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        """Rows of buckets by the batch that wrote each; a bucket whose rows all went has no folder."""
        found = None
        for batch in sorted(set(held.values())):
            try:
                rows = self.spark.read.parquet(f"{self.path}/data/batch={batch}")
            except AnalysisException as error:
                if error.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                    raise
                continue
            rows = rows.where(F.col("bucket").isin([b for b, of in held.items() if of == batch])).drop("bucket")
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return found

    def snapshot(self, batch: int | None = None) -> DataFrame | None:
        """The table after ``batch``, by default the last one."""
        return self._read(self.manifest(self.last() if batch is None else batch))

    def last(self) -> int:
        names = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/manifest")
        return names.select(F.max(F.regexp_extract("path", r"/manifest/(\d+)/", 1).cast("long")).alias("n")).first()["n"]
