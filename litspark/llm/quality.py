"""Quality rules: a hashed n-gram likelihood ratio beside plain counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty

BUCKETS = 1 << 14
PSEUDO = 30.0
#: Documents at or above this mean log-likelihood ratio (nats an n-gram) are kept.
THRESHOLD = -0.045
#: Trusted documents that the target distribution is fitted on, at most.
TRUSTED_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(column: str, n: int) -> Column:
    """Hashes of the runs of ``n`` hashes in the array column; empty where it is shorter."""
    at = F.sequence(F.lit(1), F.size(column) - (n - 1))
    return F.when(F.size(column) >= n, F.transform(at, lambda i: F.xxhash64(*[F.element_at(column, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _buckets(column: str, runs: str, buckets: int) -> Column:
    return F.transform(F.concat(column, runs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _features(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, the text, its words, their hashes (h1), hashes of word pairs (h2), and the columns ``more``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *more)
    rows = rows.withColumn("words", _words(F.col("text"))).withColumn("h1", _hashes(F.col("words")))
    return rows.withColumn("h2", _runs("h1", 2))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """log(target share / raw share) of each bucket of hashed words and word pairs.

    Raw counts are scaled to the target's total, and ``PSEUDO`` is added to either, so that a bucket tells
    little until the target should hold many of its n-grams.

    The raw multinomial counts every document. The target one is fitted on the documents of at most
    ``trusted_rows`` ids of ``trusted``, those of lowest hash, so that the ids broadcast are bounded.
    ``buckets`` counts of either kind come to the driver, whatever the input.
    """
    ids = trusted.select(F.col(id_col).alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(trusted_rows)
    rows = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(ids), F.col(id_col) == F.col("trusted_id"), "left")
    grams = _features(rows, id_col, text_col, F.col("trusted_id").isNotNull().alias("good")).select("good", F.explode(_buckets("h1", "h2", buckets)).alias("bucket"))
    counts = {(r.good, r.bucket): r.n for r in grams.groupBy("good", "bucket").agg(F.count("*").alias("n")).collect()}
    target = [counts.get((True, b), 0) for b in range(buckets)]
    raw = [counts.get((False, b), 0) + target[b] for b in range(buckets)]
    scale = sum(target) / max(1, sum(raw))
    return [math.log(t + PSEUDO) - math.log(r * scale + PSEUDO) for t, r in zip(target, raw, strict=True)]


def _repeated_words(h3: str) -> Column:
    """Words inside 3-word windows whose hash occurs twice or more in the array column."""
    placed = F.sort_array(F.transform(F.col(h3), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of(windows: Column) -> Column:
        same = lambda w, i, d: F.coalesce(F.get(windows, i + d)["h"] == w["h"], F.lit(False))
        again = F.filter(windows, lambda w, i: same(w, i, -1) | same(w, i, 1))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))

    return F.when(F.size(F.array_distinct(h3)) < F.size(h3), F.element_at(F.transform(F.array(placed), of), 1)).otherwise(0)


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, score.

    ``score`` is the mean over a document's words and word pairs of the log ratio of their hash buckets between
    trusted and all documents (0 without words). Documents that fail the base rules (fewer than 50 words, or
    more than half of them in repeated 3-word windows) or score below ``threshold`` are not kept; an equal
    score is. Native: arrays inside the row, one shuffle of ``buckets`` counts; nothing of a document is
    shuffled. Null and empty texts have no words and fail; repeated rows are judged each; an empty table gives
    no rows; without trusted documents the ratio tells nothing of them, but stays defined. Columns of any other name are left
    aside; ``carry`` hands on the whole row in a struct ``__carried``. Windows and buckets are told apart by 64-bit hashes:
    ``n_repeat_words`` would count two different windows of one text with equal hashes as repeated. A row number that
    is always 0 or more takes part in ``kept``, so that a filter on it is worked out after the arrays, not in them.
    """
    ratio = log_ratios(docs, trusted, id_col, text_col, buckets)
    # one literal of ``buckets`` doubles, folded once
    weights = F.split(F.lit(",".join(repr(r) for r in ratio)), ",").cast("array<double>")
    carried = [F.struct("*").alias("__carried")] if carry else []
    rows = _features(docs, id_col, text_col, *carried).withColumn("h3", _runs("h1", 3)).withColumn("grams", F.concat("h1", "h2"))
    no_space = F.translate("text", SPACE, "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = rows.select(
        "doc_id",
        *(["__carried"] if carry else []),
        F.size("words").cast("long").alias("n_words"),
        F.length(no_space).cast("long").alias("word_chars"),
        (F.length(no_space) - F.length(F.translate("text", SPACE + SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
        _repeated_words("h3").cast("long").alias("n_repeat_words"),
        F.when(
            F.size("grams") > 0,
            F.aggregate("grams", F.lit(0.0), lambda total, h: total + F.element_at(weights, (F.pmod(h, F.lit(buckets)) + 1).cast("int"))) / F.size("grams"),
        ).otherwise(0.0).alias("score"),
        # a filter on ``kept`` stays above this column, and so above the arrays, which would else be worked out inside it again and again
        F.monotonically_increasing_id().alias("row"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("row") >= 0)).drop("row")


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` that the rules keep, with the same columns, whatever their names; the whole row rides along.

    Null and empty texts go; repeated rows are judged each, and so are rows with a null id; an empty table stays empty.
    """
    judged = quality_rules(docs, trusted, id_col, text_col, carry=True, **options)
    return judged.where("kept").select("__carried.*")
