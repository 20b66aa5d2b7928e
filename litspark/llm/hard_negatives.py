"""Hard negatives: rows of another label that score just below an anchor's best positives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows scored at once: a slice of all rows against a block of anchors.
SLICE_ROWS = 8192
ANCHOR_ROWS = 512
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this share (over 100) of its positive's score, and no more than that.
LEAST, MOST = 80, 100
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max

_PREPARED = "id long, label long, vector binary"
_PAIR = "anchor long, anchor_id long, score long, kind int, id long, row long"


def _prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of doubles that are whole numbers."""
    for frame in frames:
        frame["vector"] = [np.floor(np.asarray(v, np.float64) * 256).astype("<f8").tobytes() for v in frame["vector"]]
        yield frame


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """One row a vector; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for at, v in enumerate(vectors):
        values = np.frombuffer(v, "<f8")
        out[at, : len(values)] = values
    return out


def scores(anchors: list[bytes], rows: list[bytes]) -> np.ndarray:
    """Inner products, exact: in doubles where no partial sum can leave their whole numbers, else in Python's integers."""
    width = max((len(v) for v in [*anchors, *rows]), default=0) // 8
    a, b = _matrix(anchors, width), _matrix(rows, width)
    if not width or not a.size or not b.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * width < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in b]
    out = [[sum(int(x) * y for x, y in zip(u, v, strict=True)) for v in whole] for u in a]
    if any(not -(1 << 62) < x < 1 << 62 for line in out for x in line):
        raise ValueError("a score needs more than 62 bits")
    return np.array(out, np.int64)


def _first(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` of the places ``at``, by falling score and then by place."""
    if len(at) > n:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - n)[len(own) - n]]
    return at[np.lexsort((at, -score[at]))][:n]


class _Block:
    """A slice of rows by ascending id (null last), scored against a block of anchors."""

    def __init__(self, anchors: pd.DataFrame, rows: pd.DataFrame):
        self.anchors = anchors.reset_index(drop=True)
        rows = rows.assign(order=rows["id"].astype("Int64").fillna(NO_ID)).sort_values(["order", "row"], kind="stable")
        self.ids, self.rows, self.labels = rows["order"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.scores = scores(self.anchors["vector"].tolist(), rows["vector"].tolist())

    def pairs(self, found: list[tuple[int, np.ndarray, int]]) -> pd.DataFrame:
        """Rows of ``_PAIR`` for places found: (anchor's place, rows' places, kind)."""
        n = [len(at) for _, at, _ in found]
        line = np.repeat(np.array([i for i, _, _ in found], np.int64), n)
        at = np.concatenate([np.zeros(0, np.int64), *[a for _, a, _ in found]])
        return pd.DataFrame(
            {
                "anchor": self.anchors["row"].to_numpy(np.int64)[line],
                "anchor_id": self.anchors["id"].astype("Int64").array[line],
                "score": self.scores[line, at],
                "kind": np.repeat(np.array([k for _, _, k in found], np.int32), n),
                "id": pd.arrays.IntegerArray(self.ids[at], self.ids[at] == NO_ID),
                "row": self.rows[at],
            }
        )


def _sliced(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))


def _copies(name: str, n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def _in_order(pairs: DataFrame, partitions: int) -> DataFrame:
    """The secondary sort: an anchor's pairs lie in one partition, by falling score, positives first, then by id.

    This is repartitionAndSortWithinPartitions on packed keys, done by Spark's own shuffle and external sort.
    """
    return pairs.repartition(partitions, "anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", F.asc_nulls_last("id"), "row")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    slice_rows: int = SLICE_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    Components count as floor(256 x); a score is the inner product with the anchor. An anchor's positives are its
    ``positives`` best other rows of its label; a positive's negatives are the ``negatives`` best rows of other labels
    that score 80 to 100 % of it (ties: smaller id, null ids last, then the row's place in the input).

    Every anchor meets every row, block by block: a slice of all rows (about ``slice_rows``) and a block of anchors
    (about ``anchor_rows``) are cogrouped, so a task holds one of each, whatever the labels' or ids' shares. A block hands
    on only what it can still contribute: its best positives, and then, when an anchor's positives are known, the
    first negatives of each of their windows. Those pairs are dealt by anchor and sorted by (anchor, falling score, id); a
    streaming iterator opens a window at each positive and emits negatives, holding open windows only.

    Rows with a null label or vector, or a null or non-finite component, take no part. Shorter vectors count as ended by
    zeros; empty ones score 0. Repeated rows are rows of their own (an anchor's copy is one of its positives). Null ids
    are values. A score beyond 62 bits is refused. Empty tables and anchors without positives give no rows.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != math.inf))
    anchor = F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    taking = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    narrow = taking.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), anchor)
    prepared = narrow.mapInPandas(_prepare, f"{_PREPARED}, is_anchor boolean").withColumn("row", F.monotonically_increasing_id())
    prepared = cut(prepared)  # rows keep their numbers
    counted = prepared.agg(F.count("*").alias("all"), F.count_if("is_anchor").alias("anchors")).first()
    slices, blocks = -(-counted["all"] // slice_rows) or 1, -(-counted["anchors"] // anchor_rows) or 1
    sliced = _sliced(prepared.drop("is_anchor"), "slice", slices).select("*", _copies("block", blocks))
    blocked = _sliced(prepared.where("is_anchor").drop("is_anchor"), "block", blocks)

    def against_all(anchors: DataFrame, f) -> DataFrame:
        left = anchors.select("*", _copies("slice", slices))
        left = left.select([F.col(c).alias(c) for c in left.columns])  # both sides stem from one table

        def scored(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return f(_Block(a, b))

        return left.groupBy("block", "slice").cogroup(sliced.groupBy("block", "slice")).applyInPandas(scored, _PAIR)

    def best_positives(block: _Block) -> pd.DataFrame:
        own = block.anchors[["label", "row"]].to_numpy(np.int64)
        return block.pairs([(i, _first(block.scores[i], np.flatnonzero((block.labels == label) & (block.rows != row)), positives), 0) for i, (label, row) in enumerate(own)])

    def best_negatives(block: _Block) -> pd.DataFrame:
        found = []
        for i, (label, windows) in enumerate(zip(block.anchors["label"], block.anchors["windows"], strict=True)):
            score = block.scores[i]
            other = np.flatnonzero(block.labels != label)
            in_window = [_first(score, other[(score[other] <= p) & (MOST * score[other] >= LEAST * p)], negatives) for p in {int(x) for x in windows}]
            found.append((i, np.unique(np.concatenate(in_window)), 1))
        return block.pairs(found)

    def first_ones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first ``positives`` rows of each anchor."""
        anchor, seen = None, 0
        for frame in frames:
            keep = []
            for a in frame["anchor"]:
                anchor, seen = (a, 1) if a != anchor else (anchor, seen + 1)
                keep.append(seen <= positives)
            yield frame[keep]

    def open_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, windows = None, []
        for frame in frames:
            out = []
            for a, a_id, score, kind, id_ in zip(frame["anchor"], frame["anchor_id"], frame["score"].tolist(), frame["kind"], frame["id"], strict=True):
                if a != anchor:
                    anchor, windows = a, []
                if kind == 0:
                    windows.append([id_, score, 0])
                    continue
                windows = [w for w in windows if w[2] < negatives and LEAST * w[1] <= MOST * score]
                for w in windows:
                    if score <= w[1]:
                        w[2] += 1
                        out.append((a_id, w[0], w[2], id_, w[1], score))
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pd.DataFrame(out, columns=names).astype({"anchor_id": "Int64", "positive_id": "Int64", "negative_id": "Int64", "rank": "int32", "positive_score": "int64", "negative_score": "int64"})

    tops = cut(_in_order(against_all(blocked, best_positives), partitions).mapInPandas(first_ones, _PAIR))
    windows = tops.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("windows"))  # at most ``positives`` each
    pairs = tops.unionByName(against_all(blocked.join(windows, "row"), best_negatives))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return _in_order(pairs, partitions).mapInPandas(open_windows, result)
