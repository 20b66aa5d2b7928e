"""An inverted index stored in buckets of tokens, with added segments, updates and merges."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import build_token_index
from .shared import cut, few

SEGMENTS = "generation int, segment int"
#: Parts by id that a bucket of a segment is dealt to, so a word of a third of all rows is split among tasks.
PARTS = 16


class TokenIndex:
    """``path``/generation=G/postings/segment=S/bucket=B holds (token, id) of the rows added as segment S, sorted.

    Parquet stores them as dictionaries and differences. A search reads the buckets of its words only, in each segment. Rows that are added
    again or removed make older postings stale: ``stale`` names their ids and the segment from which on they count,
    and a search leaves older ones out. ``merge`` writes what counts as one segment of a new generation. Segments are listed
    after they are written, so what a failed job left is not read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _listed(self) -> list[tuple[int, int]]:
        try:
            rows = self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/segments").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last = max(r.generation for r in rows)
        return sorted((r.generation, r.segment) for r in rows if r.generation == last)

    def _list(self, generation: int, segment: int) -> None:
        self.spark.createDataFrame([(generation, segment)], SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _read(self, kind: str) -> DataFrame | None:
        """Rows of one kind of all listed segments, with their segment."""
        listed = self._listed()
        if not listed:
            return None
        base = f"{self.path}/generation={listed[0][0]}/{kind}"
        rows = self.spark.read.option("basePath", base).parquet(*[f"{base}/segment={s}" for _, s in listed])
        return rows

    def _bucket(self, token):
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _write(self, generation: int, segment: int, postings: DataFrame, ids: DataFrame, stale: DataFrame, repeated: bool = False) -> None:
        at = lambda kind: f"{self.path}/generation={generation}/{kind}/segment={segment}"
        order = ["bucket", "token", "id"]
        rows = postings.select(self._bucket(F.col("token")).alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"), "token", "id")
        rows = rows.repartition("bucket", "part")
        if repeated:  # equal rows were dealt to one task, so they are made one there without another shuffle
            rows = rows.distinct()
        rows = rows.drop("part").sortWithinPartitions(*order)
        rows.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").partitionBy("bucket").parquet(at("postings"))
        ids.select("id").write.mode("overwrite").parquet(at("ids"))
        stale.select("id").write.mode("overwrite").parquet(at("stale"))
        self._list(generation, segment)

    def add(self, docs: DataFrame, id_col: str, columns: Iterable[str]) -> None:
        """Index rows as a new segment; ids that the index holds are replaced."""
        listed = self._listed()
        generation, segment = (listed[-1][0], listed[-1][1] + 1) if listed else (0, 0)
        ids = cut(docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")))
        repeated = not ids.where("n > 1").isEmpty()
        ids = ids.select("id")
        held = self._read("ids")
        again = ids.limit(0) if held is None else ids.join(held.select("id").distinct(), "id", "left_semi")
        self._write(generation, segment, build_token_index(docs, id_col, columns), ids, again, repeated)

    def remove(self, ids: DataFrame) -> None:
        """Leave the rows of these ids (id) out from now on."""
        generation, segment = self._listed()[-1]
        ids = ids.select("id").distinct()
        self._write(generation, segment + 1, ids.select(F.lit("").alias("token"), "id").limit(0), ids.limit(0), ids)

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """(token, id) that count, of all words or of ``words``, whose buckets alone are read."""
        found = self._read("postings")
        if words is not None:
            buckets = [r.b for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(self._bucket(F.col("w")).alias("b")).collect()]
            found = found.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("token").isin(words))
        return self._counting(found).select("token", "id")

    def _counting(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, segment) without those that a later segment replaces or removes."""
        stale = self._read("stale")
        if stale.isEmpty():
            return rows
        since = cut(stale.groupBy("id").agg(F.max("segment").alias("since")))
        return rows.join(few(since), "id", "left").where(F.col("since").isNull() | (F.col("segment") >= F.col("since")))

    def search(self, query: str) -> DataFrame:
        """(id, words): rows that hold any word of ``query``, and how many of them."""
        words = sorted(set(re.findall("[a-z0-9]+", query.lower())))
        if not words:
            raise ValueError("no word to search")
        # an id counts in one segment, which has each of its words once
        return self.postings(words).groupBy("id").agg(F.count("*").alias("words"))

    def merge(self) -> None:
        """Write what counts as one segment; searches that have begun read the old one."""
        generation = self._listed()[-1][0]
        postings = self.postings()
        ids = self._counting(self._read("ids")).select("id").distinct()
        self._write(generation + 1, 0, postings, ids, ids.limit(0))
