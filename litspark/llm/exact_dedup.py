"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut_compact, text_or_empty

BLOCK_BYTES = 8192
NAME_BUCKETS = 65_536


def _name(distinct: DataFrame, route, order: list[str]) -> DataFrame:
    """Number distinct rows by sorting: rows are dealt to buckets by a hash and ranked inside their bucket.

    (bucket, rank) is one integer, and two different rows never share it.
    """
    bucketed = distinct.withColumn("bucket", F.pmod(route, F.lit(NAME_BUCKETS)))
    ranked = Window.partitionBy("bucket").orderBy(*order)
    rank = F.row_number().over(ranked).cast("long") - 1
    return bucketed.withColumn("name", rank * NAME_BUCKETS + F.col("bucket"))


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct (id, text): doc_id, text_sha256, n_blocks, name, n (rows that were equal).

    Two rows have equal texts exactly when (n_blocks, name) are equal. Texts are cut into blocks of
    ``block_bytes``; distinct blocks are sorted into integer names; then adjacent names are paired and the
    distinct pairs sorted into names again, until each text has one. A 64-bit hash only routes blocks;
    blocks whose hash is shared are joined by their bytes.
    """
    normal = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).cast("binary").alias("bytes"))
    whole = normal.select(
        "doc_id",
        F.sha2("bytes", 256).alias("text_sha256"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int").alias("n_blocks"),
        "bytes",
    )
    blocks = whole.select(
        "doc_id",
        "text_sha256",
        "n_blocks",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
    ).withColumn("h", F.xxhash64("block"))

    near = Window.partitionBy("bucket").orderBy("h", "block")
    named = _name(blocks.select("h", "block").distinct(), F.col("h"), ["h", "block"])
    named = named.withColumn("twin", F.coalesce(F.lag("h").over(near) == F.col("h"), F.lit(False)) | F.coalesce(F.lead("h").over(near) == F.col("h"), F.lit(False)))
    named = cut_compact(named.select("h", "name", "twin", F.when(F.col("twin"), F.col("block")).alias("block")))
    places = ["doc_id", "text_sha256", "n_blocks", "pos"]
    level = blocks.select(*places, "h").join(named.where("not twin").select("h", "name"), "h").select(*places, "name")
    twins = named.where("twin").select("h", "block", "name")
    if not twins.isEmpty():
        level = level.unionByName(blocks.join(twins, ["h", "block"]).select(*places, "name"))
    level = cut_compact(level.select(*places, "name", F.col("n_blocks").alias("left"), F.lit(1).cast("long").alias("n")))

    finished = level.where("left = 1").select("doc_id", "text_sha256", "n_blocks", "name", "n")
    longest = level.agg(F.max("left")).first()[0] or 1
    while longest > 1:
        first = F.col("pos") % 2 == 0
        pairs = (
            level.where("left > 1")
            .groupBy("doc_id", "text_sha256", "n_blocks", (F.floor(F.col("pos") / 2)).cast("int").alias("pos"), F.ceil(F.col("left") / 2).cast("int").alias("left"))
            .agg(F.max(F.when(first, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(-1).cast("long")).alias("b"), F.sum(F.when(first, F.col("n"))).alias("n"))
        )
        pairs = cut_compact(pairs)
        names = _name(pairs.select("a", "b").distinct(), F.xxhash64("a", "b"), ["a", "b"]).select("a", "b", "name")
        level = cut_compact(pairs.join(names, ["a", "b"]).select(*places, "name", "left", "n"))
        finished = finished.unionByName(level.where("left = 1").select("doc_id", "text_sha256", "n_blocks", "name", "n"))
        longest = (longest + 1) // 2
    return finished.groupBy("doc_id", "text_sha256", "n_blocks", "name").agg(F.sum("n").alias("n"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct (id, text): doc_id, text_sha256, n, keep_id, group_size, by equal names.

    Sizes and ids are summed up before they are shuffled; the join back on names of many rows may be split by AQE.
    """
    named = cut_compact(block_names(docs, id_col, text_col, block_bytes))
    groups = named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return named.join(groups, ["n_blocks", "name"]).select("doc_id", "text_sha256", "n", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id
    stays; of repeated rows with one id and text, one stays. A null id is smaller than any other. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = _grouped(docs, id_col, text_col, block_bytes).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies, with the same columns, whatever their names.

    What stays is decided by names as in ``exact_dedup``; its row is found again by its id and text's SHA-256.
    Null and empty texts are equal; of repeated rows of one id and text one stays (any of them, where they differ in
    other columns); an empty table stays empty.
    """
    kept = cut_compact(_grouped(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(_row_key("doc_id", F.col("text_sha256")).alias("kept_key"), "n"))
    sha = F.sha2(ascii_lower(text_or_empty(text_col)).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("row"), _row_key(id_col, sha).alias("key"))
    stay = rows.join(kept.select("kept_key"), F.col("key") == F.col("kept_key"), "left_semi")
    if not kept.where("n > 1").isEmpty():
        stay = stay.dropDuplicates(["key"])
    return stay.select("row.*")


def _row_key(id_col: str, other) -> Column:
    """One value of an id, which may be null, and another value: structs of equal members are equal, null or not."""
    return F.struct(F.col(id_col).alias("id"), other.alias("of"))
