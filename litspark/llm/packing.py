"""Cost-balanced packing of documents into sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import encoder, vocabulary_path

SEQUENCE_TOKENS = 4096
CHUNK_TOKENS = 1 << 21
BATCH_TEXTS = 256
#: Cost of a piece of n tokens: n, and n * n for attention, as shares of a full sequence's.
LINEAR, QUADRATIC = 1.0, 1.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, est_cost double"


def cost(tokens: float, size: int = SEQUENCE_TOKENS) -> float:
    return LINEAR * tokens / size + QUADRATIC * (tokens / size) ** 2


def pack(lengths: np.ndarray, size: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths, without padding.

    Full sequences are cut off first. What remains fills as many sequences as it has tokens for: in
    descending order each remainder goes to the sequence of lowest estimated cost that has room, and where
    none has, it is cut over those of lowest cost. The one sequence that cannot be full is cut into powers of
    two, which need no padding.
    """
    pieces, sequence = [], 0
    rest = []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - size + 1, size):
            pieces.append((d, start, size, sequence, 0))
            sequence += 1
        if n % size:
            rest.append((n % size, d, n - n % size))
    rest.sort(key=lambda r: (-r[0], r[1]))
    total = sum(n for n, _, _ in rest)
    room = [size] * (total // size) + ([total % size] if total % size else [])
    filled: list[list] = [[] for _ in room]
    queue = [(0.0, s) for s in range(len(room))]

    def put(n: int, d: int, start: int, c: float, s: int) -> None:
        filled[s].append((d, start, n))
        room[s] -= n
        if room[s]:
            heapq.heappush(queue, (c + cost(n, size), s))

    for n, d, start in rest:
        passed = []
        while queue and room[queue[0][1]] < n:
            passed.append(heapq.heappop(queue))
        if queue:
            put(n, d, start, *heapq.heappop(queue))
            for entry in passed:
                heapq.heappush(queue, entry)
            continue
        for k, (c, s) in enumerate(passed):
            part = min(n, room[s])
            put(part, d, start, c, s)
            n, start = n - part, start + part
            if not n:
                for entry in passed[k + 1 :]:
                    heapq.heappush(queue, entry)
                break
    last = total % size
    bins: list[tuple[list, list[int]]] = [(f, [size]) for f in filled[: total // size]]
    if last:
        bins.append((filled[-1], [1 << b for b in range(last.bit_length() - 1, -1, -1) if last >> b & 1]))
    for content, caps in bins:
        caps, used = list(caps), 0
        for d, start, n in content:
            while n:
                part = min(n, caps[0] - used)
                pieces.append((d, start, part, sequence, used))
                start, n, used = start + part, n - part, used + part
                if used == caps[0]:
                    caps.pop(0)
                    sequence, used = sequence + 1, 0
    return pieces


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, tokenizer_path: str | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, est_cost.

    Each partition is packed by itself, some ``chunk_tokens`` at a time, so nothing is shuffled and a task
    holds one chunk at most (besides a document larger than that). Sequence ids name the partition and a number in it. Null texts are
    empty documents of one end id; repeated rows are packed each; an empty table gives no rows; columns of other names are left
    aside. Of equal remainders the earlier row goes first. Which rows share a sequence depends on how the table is partitioned, as
    each partition is packed alone; pieces, lengths and checksums of a document do not leave it.
    """
    vocabulary = tokenizer_path or vocabulary_path()

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal base, held, tokens
            doc_ids = np.concatenate([h[0] for h in held])
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            first = np.cumsum(lengths) - lengths
            d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pack(lengths, size), strict=True))
            at = first[d] + start
            out = pd.DataFrame(
                {
                    "doc_id": pd.array(doc_ids[d], dtype="Int64"),
                    "start": start,
                    "length": length,
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(at, at + length, strict=True)],
                    "doc_tokens": lengths[d],
                    "sequence_id": base + sequence,
                    "offset": offset,
                    "est_cost": cost(length.astype(np.float64), size),
                }
            )
            base, held, tokens = base + int(sequence.max()) + 1, [], 0
            return out

        for frame in frames:
            for at in range(0, len(frame), BATCH_TEXTS):
                some = frame.iloc[at : at + BATCH_TEXTS]
                ids, lengths = encoder(vocabulary).encode(some["text"].tolist())
                held.append((some["doc_id"].astype("Int64").to_numpy(dtype=object), ids.astype("<u4"), lengths))
                tokens += len(ids)
                if tokens >= chunk_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(pieces, SCHEMA)
