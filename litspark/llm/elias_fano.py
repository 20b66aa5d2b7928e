"""Token files: concatenated ids with Elias-Fano coded document ends."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, text_or_empty
from .tokens import encoder, vocabulary_path

MAGIC = b"EFT2"
HEADER = "<4sBBIQI"  # magic, bytes an id, low bits an end, documents, ids, bytes of high bits
BLOCK_IDS = 1 << 20
SAMPLE = 64
BATCH_TEXTS = 256
# of each byte, how many ones it has, and the place of its first, second, ... one
_ONES = np.array([b.bit_count() for b in range(256)], np.int64)
_PLACES = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """Non-decreasing integers in about 2 + log2(largest / count) bits each.

    The low bits of each value are packed; the high parts stand in unary, so the i-th value is the position
    of the i-th one less i. Positions of every ``SAMPLE``-th one are kept and start the search of ``select``.
    """

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, sampled: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.sampled = count, low_bits, low, high, sampled

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        count = len(values)
        largest = int(values[-1]) if count else 0
        low_bits = max(0, (largest // count).bit_length() - 1) if count else 0
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        unary = np.zeros(count + (largest >> low_bits) + 1, np.uint8)
        unary[(values >> low_bits) + np.arange(count)] = 1
        return cls(count, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), np.flatnonzero(unary)[::SAMPLE].astype("<u4"))

    def _low(self, which: np.ndarray) -> np.ndarray:
        at = which[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        which = np.arange(self.count)
        return ((ones - which) << self.low_bits) | self._low(which)

    def select(self, which):
        """The values at the places ``which`` (an array, or one integer): from the sampled one before each, whole bytes are
        skipped by their counts of ones."""
        places = np.atleast_1d(np.asarray(which, np.int64))
        start = self.sampled[places // SAMPLE].astype(np.int64)
        byte, need = start >> 3, places % SAMPLE
        here = self.high[byte].astype(np.int64) >> (start & 7) << (start & 7)
        short = np.flatnonzero(need >= _ONES[here])
        while len(short):
            need[short] -= _ONES[here[short]]
            byte[short] += 1
            here[short] = self.high[byte[short]]
            short = short[need[short] >= _ONES[here[short]]]
        values = ((byte * 8 + _PLACES[here, need] - places) << self.low_bits) | self._low(places)
        return int(values[0]) if np.ndim(which) == 0 else values


def write_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    ends = EliasFano.encode(np.cumsum(lengths))
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = struct.pack(HEADER, MAGIC, width, ends.low_bits, len(lengths), len(ids), len(ends.high))
    return b"".join([head, ends.sampled.tobytes(), ends.high.tobytes(), ends.low.tobytes(), ids.astype(f"<u{width}").tobytes()])


def read_block(block: bytes) -> tuple[np.ndarray, EliasFano]:
    magic, width, low_bits, docs, n_ids, high_bytes = struct.unpack_from(HEADER, block)
    if magic != MAGIC:
        raise ValueError("not a block of a token file")
    samples = -(-docs // SAMPLE)
    sampled = np.frombuffer(block, "<u4", samples, struct.calcsize(HEADER))
    at = struct.calcsize(HEADER) + 4 * samples
    high = np.frombuffer(block, np.uint8, high_bytes, at)
    low_bytes = (docs * low_bits + 7) // 8
    low = np.frombuffer(block, np.uint8, low_bytes, at + high_bytes)
    return np.frombuffer(block, f"<u{width}", n_ids, at + high_bytes + low_bytes), EliasFano(docs, low_bits, low, high, sampled)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write token files to ``path``: documents in ascending id (nulls first, ties by the text's hash and text),
    each text's ids and then the end id.

    A file is Parquet with one row a block: shard, block, doc_ids and the block's bytes. Spark's writer commits
    them, so any store that Spark writes will do and a lost task is written again. Null texts are empty; an
    empty table makes no block.
    """
    vocabulary = tokenizer_path or vocabulary_path()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, block, held = TaskContext.get().partitionId(), 0, []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal block, held, size
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            doc_ids = np.concatenate([h[0] for h in held])
            out = pd.DataFrame({"shard": [shard], "block": [block], "n_ids": [len(ids)], "doc_ids": [[None if pd.isna(d) else int(d) for d in doc_ids]], "bytes": [write_block(ids, lengths)]})
            block, held, size = block + 1, [], 0
            return out

        for frame in frames:
            for at in range(0, len(frame), BATCH_TEXTS):
                some = frame.iloc[at : at + BATCH_TEXTS]
                ids, lengths = encoder(vocabulary).encode(some["text"].tolist())
                held.append((some["doc_id"].astype("object").to_numpy(), ids, lengths))
                size += len(ids)
                if size >= block_ids:
                    yield flush()
        if held:
            yield flush()

    ordered.select("doc_id", "text").mapInPandas(blocks, "shard int, block int, n_ids long, doc_ids array<long>, bytes binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document of the token files at ``path``: doc_id, start, n_tokens, ids_crc32, shard, block.

    Ends come from ``select`` on the block's stored samples. Only counts cross tasks: each shard's blocks are summed, and so are the shards before it.
    """
    files = spark.read.parquet(path)

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, ends = read_block(row.bytes)
                upto = ends.select(np.arange(ends.count))
                starts = np.concatenate([[0], upto[:-1]]).astype(np.int64) if len(upto) else upto
                wide = ids.astype("<u4")
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(list(row.doc_ids), dtype="Int64"),
                        "local": starts,
                        "n_tokens": upto - starts,
                        "ids_crc32": [zlib.crc32(wide[a:b]) for a, b in zip(starts, upto, strict=True)],
                        "shard": row.shard,
                        "block": row.block,
                    }
                )

    found = files.select("shard", "block", "doc_ids", "bytes").mapInPandas(documents, "doc_id long, local long, n_tokens long, ids_crc32 long, shard int, block int")
    blocks = files.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", (F.sum("ids").over(before) - F.col("ids")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = blocks.select("shard", "block", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("block_start")).join(F.broadcast(shards), "shard")
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files into the shared folder and read them back (see ``read_token_files``)."""
    path = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, path, id_col, text_col, tokenizer_path)
    return read_token_files(docs.sparkSession, path)
