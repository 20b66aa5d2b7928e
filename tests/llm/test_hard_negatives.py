"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import hard_negatives as H
from litspark.llm import queries


def brute(rows, is_anchor):
    taking = [(i, label, [math.floor(256 * x) for x in v], n) for n, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, label, u, n in taking:
        if not is_anchor(a):
            continue
        scored = sorted(((sum(x * y for x, y in zip(u, v)), i, other) for i, other, v, m in taking if m != n), key=first)
        for p, i, _ in [r for r in scored if r[2] == label][:5]:
            near = [r for r in scored if r[2] != label and 80 * p <= 100 * r[0] <= 100 * p][:5]
            out += [(a, i, k, r[1], p, r[0]) for k, r in enumerate(near, 1)]
    return out


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, label int, embedding array<float>, row int, id int, slice string")


@pytest.mark.parametrize(("slice_rows", "anchor_rows"), [(8192, 512), (40, 3)])
def test_mined(spark, slice_rows, anchor_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.choice([-1.0, -0.25, 0.0, 0.5, 0.75, 1.0]) for _ in range(4)]) for i in range(-50, 250)]
    rows += [(300, None, [1.0] * 4), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0]), (303, 0, [math.inf, 0.0, 0.0, 0.0]), (304, 0, [math.nan] * 4), (400, 5, [1.0] * 4), (500, 1, []), (305, 1, [1.0])]
    got = plain(H.hard_negatives(frame(spark, rows), F.col("vec_id") % 25 == 0, slice_rows=slice_rows, anchor_rows=anchor_rows))
    assert got == sorted(brute(rows, lambda i: i is not None and i % 25 == 0), key=repr) and got


def test_repeated_rows_and_null_ids(spark):
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (None, 2, [0.5, 0.4]), (None, 1, [0.25, 0.5]), (3, 2, [0.5, 0.4]), (3, 2, [0.5, 0.4])]
    assert plain(H.hard_negatives(frame(spark, rows), F.col("vec_id") == 0, slice_rows=2)) == sorted(brute(rows, lambda i: i == 0), key=repr)


def test_large_components_stay_exact():
    big = np.array([2.0**40 + 1, 3.0]).astype("<f8").tobytes()
    small = np.array([2.0**15 + 1, 1.0]).astype("<f8").tobytes()
    assert H.scores([big], [small])[0, 0] == (2**40 + 1) * (2**15 + 1) + 3
    with pytest.raises(ValueError):
        H.scores([big], [big])


def test_empty_tables(spark):
    assert H.hard_negatives(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert H.hard_negatives(frame(spark, [(1, 1, [1.0])]), F.col("vec_id") == 0).count() == 0


def test_query_moves_labels(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in queries.table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    assert plain(queries.op13_hard_negatives(spark, "/root/testdata/sf0.001")) == sorted(brute(rows, lambda i: i % 100 == 0), key=repr)
