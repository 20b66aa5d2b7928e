"""Mix sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
LEAF_DOCS = 4096
FAN_IN = 64
#: A document is heavy if this many of its size exceed its source's target.
HEAVY = 100
SEED = 20
#: Open fractions of a source's heavy documents that are settled together, the smallest ones.
OPEN = 12
#: Documents whose copies are all tried where a source has no other way to its target, and how near it is near enough.
WIDENED, NEAR = 8, 0.001
#: Fractions this close to an integer are integral.
EPS = 1e-9


def source_targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> list[tuple[str | None, float]]:
    """Words each source should give: shares of all words by weight, at most ``max_repeat`` times its own,
    with what is above that reshared by weight until none is above. Sources go by code point, null last."""
    order = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    target: dict = {}
    free, left = list(size), float(sum(size.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > max_repeat * size[s]]
        if not full:
            target.update({s: unit * weight[s] for s in free})
            break
        for s in full:
            target[s] = float(max_repeat * size[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return [(s, target[s]) for s, _ in order]


def pivot(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions ``part`` to 0 or 1, but for one at most, keeping sum(size * part) as it is.

    Two open fractions trade words until one is integral; the direction is drawn so that each keeps its
    expectation.
    """
    part = part.copy()
    draws = rng.random(len(part))
    open_ = -1
    for j in range(len(part)):
        if part[j] < EPS or part[j] > 1 - EPS:
            part[j] = round(part[j])
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        up = min((1 - part[i]) * size[i], part[j] * size[j])
        down = min(part[i] * size[i], (1 - part[j]) * size[j])
        move = up if draws[j] * (up + down) < down else -down
        part[i] += move / size[i]
        part[j] -= move / size[j]
        for k in (i, j):
            if part[k] < EPS or part[k] > 1 - EPS:
                part[k] = round(part[k])
        open_ = i if 0 < part[i] < 1 else j if 0 < part[j] < 1 else -1
    return part


def settle(size: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Round the last open fractions of a source (one for each size class) so that their words come nearest to the sum.

    The 16 largest are tried together; a smaller one weighs less than a 2**15th of the largest, and the 16 make up for its rounding.
    """
    out, open_ = np.round(part), np.flatnonzero((part > EPS) & (part < 1 - EPS))
    if len(open_):
        large = open_[np.argsort(-size[open_], kind="stable")][:16]
        rest = np.setdiff1d(open_, large)
        out[rest] = part[rest] >= 0.5
        wanted = float((size[open_] * part[open_]).sum() - (size[rest] * out[rest]).sum())
        picks = (np.arange(1 << len(large))[:, None] >> np.arange(len(large))) & 1
        out[large] = picks[np.argmin(np.abs(picks @ size[large] - wanted))]
    return out


def _rounded(group: pd.DataFrame, how) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "tie", "size"], kind="stable", na_position="first").reset_index(drop=True)
    return group.assign(part=how(group["size"].to_numpy(np.float64), group["part"].to_numpy(np.float64)))


def _leaf(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    rng = np.random.default_rng([SEED, zlib.crc32(repr(tuple(int(k) for k in key)).encode())])
    return _rounded(group, lambda size, part: pivot(size, part, rng))


def _root(group: pd.DataFrame) -> pd.DataFrame:
    return _rounded(group, settle)


def settle_heavy(size: np.ndarray, base: np.ndarray, part: np.ndarray, rng: np.random.Generator, widen: int = 0) -> np.ndarray:
    """Rounded fractions of a source's heavy documents: all but the ``OPEN`` smallest open ones by pivots, those together.

    With ``widen`` (most copies of a document), and if that leaves the sum off by more than ``NEAR``, the copies of ``WIDENED``
    documents, from the smallest to the largest, are chosen freely, so as to come nearest to the sum, and then nearest to their fractions: a few heavy
    documents have no sum near a target if each may only be rounded up or down.
    """
    wanted = float((size * (base + part)).sum())
    open_ = np.flatnonzero((part > EPS) & (part < 1 - EPS))
    early = np.sort(open_[np.argsort(size[open_], kind="stable")][OPEN:])
    out = part.copy()
    out[early] = pivot(size[early], part[early], rng)
    out = settle(size, out)
    left = wanted - float((size * (base + out)).sum())
    if widen and abs(left) > NEAR * wanted:
        free = np.flatnonzero(size > 0)
        free = free[np.argsort(size[free], kind="stable")]
        free = free[np.unique(np.linspace(0, len(free) - 1, min(WIDENED, len(free))).round().astype(int))]
        copies = np.indices((widen + 1,) * len(free)).reshape(len(free), -1).T
        off = np.abs(copies @ size[free] - float((size[free] * (base + out)[free]).sum()) - left)
        moved = np.abs(copies - (base + part)[free]) @ size[free]
        out[free] = copies[np.lexsort((moved, np.round(off, 6)))[0]] - base[free]
    return out


def _heavy(widen: int):
    def rounded(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([SEED, zlib.crc32(repr(tuple(int(k) for k in key)).encode())])
        group = group.sort_values(["doc_id", "tie", "size"], kind="stable", na_position="first").reset_index(drop=True)
        return group.assign(part=settle_heavy(*(group[c].to_numpy(np.float64) for c in ("size", "base", "part")), rng, widen))

    return rounded


def _fractions(rows: DataFrame, plan: DataFrame, heavy: bool, max_repeat: int) -> DataFrame:
    """Whole copies (base) and the fraction of one more (part) of the heavy or of the other documents."""
    light = F.col("size") * HEAVY <= F.col("target")
    ratio = F.least(F.greatest(F.col("ratio"), F.lit(0.0)), F.lit(float(max_repeat)))
    return rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["source_name"])).where(~light if heavy else light).select(
        "doc_id",
        "tie",
        "size",
        "source_no",
        F.floor(ratio + EPS).cast("long").alias("base"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - F.floor(ratio + EPS))).otherwise(0.0).alias("part"),
        F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")))).otherwise(-1).cast("int").alias("size_class"),
        F.pmod(F.xxhash64("doc_id", "tie"), F.col("buckets")).alias("node"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source, tie.

    A document of a source that is to give ``x`` times its words is taken floor(x) times and, by its rounded
    fraction, once more. A source's heavy documents (over 1/``HEAVY`` of its target each, so few) are rounded
    first, and the others make up for what that left over. Fractions are rounded in groups of one source, one
    size class (powers of two) and one bucket of the id's hash, sized to hold about ``LEAF_DOCS`` documents
    whatever the source's share (a source of few heavy documents alone may take some of them more or less often, ``settle_heavy``); each group leaves one open fraction at most, and a tree of groups rounds what
    is left until a source has one for each size class. The draws depend on the groups' names alone, so
    reruns agree on any cluster. Only one row a source comes to the driver. Null ids, sources and texts are
    values like any other (null text: no words); documents without words are taken with 0 words; repeated
    rows are separate documents; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    rows = cut(rows)
    totals = {r.source: (r.words, r.docs) for r in rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()}
    targets = source_targets([(s, w) for s, (w, _) in totals.items()], weights, max_repeat)
    columns = "source_no int, source_name string, source_size long, target double, ratio double, buckets long"
    shares = [(no, s, totals[s][0], t, t / totals[s][0] if totals[s][0] else 0.0, 1 + totals[s][1] // LEAF_DOCS) for no, (s, t) in enumerate(targets)]
    plan = spark.createDataFrame(shares, columns)
    open_ = _fractions(rows, plan, True, max_repeat)
    schema = open_.schema
    heavy = cut(open_.groupBy("source_no").applyInPandas(_heavy(0), schema))
    copies = F.col("base") + F.round("part").cast("long")

    def given(rows: DataFrame) -> dict[int, tuple[int, int]]:
        return {r.source_no: (r.taken, r.words) for r in rows.groupBy("source_no").agg(F.sum(copies * F.col("size")).alias("taken"), F.sum("size").alias("words")).collect()}

    gave = given(heavy)
    # sources whose light documents, taken not at all or as often as may be, cannot make up for what the heavy ones left
    bound = [no for no, _, w, t, _, _ in shares if no in gave and not 0 <= t - gave[no][0] <= max_repeat * (w - gave[no][1])]
    if bound:
        widened = open_.where(F.col("source_no").isin(bound)).groupBy("source_no").applyInPandas(_heavy(max_repeat), schema)
        heavy = cut(heavy.where(~F.col("source_no").isin(bound)).unionByName(widened))
        gave = given(heavy)
    shares = [(no, s, w, t, (t - gave[no][0]) / (w - gave[no][1]) if no in gave and w > gave[no][1] else ratio, b) for no, s, w, t, ratio, b in shares]
    plan = spark.createDataFrame(shares, columns)
    open_ = _fractions(rows, plan, False, max_repeat)
    is_open = f"part > {EPS} and part < 1 - {EPS}"
    nodes = max([b for *_, b in shares], default=1)
    done = [heavy]
    while True:
        tried = cut(open_.groupBy("source_no", "size_class", "node").applyInPandas(_leaf, schema))
        done.append(tried.where(f"not ({is_open})"))
        open_ = tried.where(is_open).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).select(*schema.names)
        if nodes <= 1:
            break
        nodes = -(-nodes // FAN_IN)
    done.append(open_.groupBy("source_no").applyInPandas(_root, schema))
    taken = done[0]
    for more in done[1:]:
        taken = taken.unionByName(more)
    return taken.join(F.broadcast(plan), "source_no").select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("source_name").alias("source"), "tie"
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, with the same columns, whatever their names.

    Nulls are values like any other; repeated rows of one id, text and source are numbered and taken one by one, so each
    keeps its own other columns; an empty table stays empty.
    """

    def numbered(rows: DataFrame, order) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(order)))

    key = lambda id_, tie, source: F.struct(F.col(id_).alias("id"), tie.alias("tie"), F.col(source).alias("source")).alias("key")  # noqa: E731  equal with equal members, null or not
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = numbered(taken.select(key("doc_id", F.col("tie"), "source"), "copies"), F.desc("copies"))
    rows = numbered(docs.select(F.struct("*").alias("row"), key(id_col, F.xxhash64(text_or_empty(text_col)), source_col)), F.xxhash64("row"))
    both = rows.join(taken.where("copies > 0"), ["key", "nth"])
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
