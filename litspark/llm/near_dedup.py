"""Near-duplicates by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut_compact, text_or_empty

K = 5
SIMILARITY = 0.8
#: Sketches a document, and k-mers in each.
SKETCHES, ORDERED = 20, 3
SEED = 6
#: Rounds of leaders in a bucket, before texts of different labels are aligned.
ROUNDS = 2
#: Up to so many keys (16 bytes and an id each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
MEMO_WORDS = 30_000
#: Rows with all runs of a text (some 8 KB each) in a written file.
ROWS_OF_RUNS = 2_000
#: Rows with a whole text.
ROWS_OF_TEXTS = 10_000
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def kmers(text: str | None, k: int = K) -> np.ndarray:
    """Hashes of a text's k-word runs in order, each labelled with how many equal ones stand before it.

    Words are lower-cased (A-Z). A text of fewer than ``k`` words is one run; one without words has none.
    """
    words = (text or "").encode("utf-8", "replace").translate(_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    run = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        run = (run + h[i : i + n]) * _MUL
        run ^= run >> np.uint64(29)
    run = _mix(run)
    order = np.argsort(run, kind="stable")
    ordered = run[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not new.all():
        at = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        run = np.where(nth > 0, _mix(run + nth * _MUL), run)
    return run


def order_sketch(labelled: np.ndarray, sketches: int = SKETCHES, ordered: int = ORDERED) -> np.ndarray:
    """For each of ``sketches`` random orders, the hash of the ``ordered`` smallest labelled k-mers as the text has them."""
    if not len(labelled):
        return np.empty(0, np.int64)
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(SEED * 2 + 1) * _MUL)
    n = min(ordered, len(labelled))
    rank = _mix(labelled[None, :] ^ seeds[:, None])
    least = np.argpartition(rank, n - 1, axis=1)[:, :n] if n < len(labelled) else np.broadcast_to(np.arange(n), (sketches, n))
    chosen = labelled[np.sort(least, axis=1)]
    out = seeds.copy()
    for i in range(n):
        out = _mix((out + chosen[:, i]) * _MUL)
    return out.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of labelled k-mers of both texts that a banded alignment matches in order (0 if below ``least``).

    With M matched of n and m the similarity is M / (n + m - M). To reach ``least`` no more than
    (n + m)(1 - least)/(1 + least) may stay unmatched, so no match is that far off the diagonal: only those
    in the band count. Labelled k-mers are distinct in a text, so the longest alignment is the longest
    increasing run of places.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    if abs(n - m) > band:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    places = at_b[near][np.argsort(at_a[near], kind="stable")]
    matched = len(places)
    if matched / (n + m - matched) < least - 1e-12:
        return 0.0
    if matched > 1 and (places[1:] < places[:-1]).any():
        from bisect import bisect_left

        tails: list[int] = []
        for p in places.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        matched = len(tails)
    similarity = matched / (n + m - matched)
    return similarity if similarity >= least - 1e-12 else 0.0


def text_key(text: Column) -> Column:
    """Equal for texts that are equal but for the case of A-Z."""
    return F.unhex(F.md5(ascii_lower(text).cast("binary")))


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, sketch): n is the number of the text's runs."""

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            runs, found = [], []
            for text in frame["text"]:
                labelled = kmers(text)
                runs.append(len(labelled))
                found.append(order_sketch(labelled))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "key": frame["key"], "n": runs, "sketch": found})

    return docs.mapInPandas(sketch, "doc_id long, key binary, n int, sketch array<long>")


def _texts_of(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys, which come with one document's id each."""
    keys = keys.select(F.col("key").alias("wanted"), F.col("rep").alias("wanted_id"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    on = (F.col("key") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    return cut_compact(keyed.join(keys, on).select("key", "text"), ROWS_OF_TEXTS)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with their similarity, 0 where it is below ``least``; several pairs may share a ``b``.

    Rows reach a worker by ``b``, whose runs are worked out once; a ``b`` of very many pairs may be split among tasks.
    """

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of_last = None, None
        for frame in frames:
            found = []
            for b, left, right in zip(frame["b"], frame["left"], frame["right"], strict=True):
                if b != last:
                    last, of_last = b, kmers(right)
                found.append(aligned_similarity(kmers(left), of_last, least))
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": found})

    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b")
    return cut_compact(both.select("a", "b", "left", "right").mapInPandas(align, "a binary, b binary, similarity double").distinct())


def _prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(run, key, n, reach, s1, s2, s3): the runs by which texts (key, text) that may reach ``least`` must meet.

    Runs are ordered by how few of the texts have them. Two texts of n and m runs with
    M / (n + m - M) >= least have least * n runs in common, so the first of these is among the first
    n - least * n + 1 of each, and from it on both have the M = (n + m) * least / (1 + least) runs they need. So a
    text with A runs from a place on meets there only texts of A * (1 + least) / least - n runs or fewer (its reach).
    Texts whose reach is less than the shortest, or that no reach includes, leave a run before any two are paired.
    s1 to s3 are runs from the start, the first and the second third of a text's first ones: alike texts agree in them.
    """

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                some = frame.iloc[at : at + 1000]
                found = [kmers(t).view(np.int64) for t in some["text"]]
                yield pd.DataFrame({"key": some["key"].to_numpy(), "n": [len(f) for f in found], "runs": found})

    rows = texts.dropDuplicates(["key"]).mapInPandas(runs, "key binary, n int, runs array<long>")
    rows = cut_compact(rows.withColumn("nth", F.monotonically_increasing_id()), ROWS_OF_RUNS)
    each = rows.select("nth", F.explode("runs").alias("run"))
    common = each.join(each.groupBy("run").agg(F.count("*").alias("texts")).where("texts > 1"), "run")
    common = common.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("texts", "run"))).alias("common"))
    own = F.col("n") - F.size("common")
    first = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - own).cast("int")
    rows = rows.select("nth", "key", "n").join(common, "nth").select("key", "n", F.size("common").alias("size"), F.when(first > 0, F.slice("common", 1, first)).alias("first"))
    marks = [F.get("first", F.floor(F.size("first") * k / 3).cast("int"))["run"].alias(f"s{k + 1}") for k in range(3)]
    rows = rows.select("key", "n", "size", *marks, F.posexplode("first").alias("place", "of"))
    reach = (F.col("size") - F.col("place")) * (1 + least) / least - F.col("n") + 1e-9
    rows = cut_compact(rows.select(F.col("of.run").alias("run"), "key", "n", reach.alias("reach"), "s1", "s2", "s3"))
    ends = rows.groupBy("run").agg(F.min("n").alias("shortest"), F.max("reach").alias("longest"))
    return cut_compact(rows.join(ends, "run").where("reach >= shortest and n <= longest").drop("shortest", "longest"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with each text's label, its own key where it has none."""
    return rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _neighbours(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels that stand side by side in a run, by s1 to s3: a pair a row at most.

    They join most texts of one form, whose pairs in a run would be very many, before the rest are paired.
    """

    def beside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            out = []
            for row in zip(frame["run"], frame["key"], frame["label"], frame["n"], frame["reach"], strict=True):
                if last and last[0] == row[0] and last[2] != row[2] and last[3] <= row[4] and row[3] <= last[4]:
                    out.append((min(last[1], row[1]), max(last[1], row[1])))
                last = row
            yield pd.DataFrame(out, columns=["a", "b"])

    order = ["run", "s1", "s2", "s3", "key"]
    partitions = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _labelled(prefixes, labels).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return rows.mapInPandas(beside, "a binary, b binary").distinct()


def _close_pairs(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels that share one of their ``_prefixes``; no pair that reaches the similarity is left out.

    Runs that only one label is left in go. Pairs are of a text outside a run's commonest label with any other,
    so members of one class, however large, are not paired.
    """
    rows = _labelled(prefixes.drop("s1", "s2", "s3"), labels)
    of_label = rows.groupBy("run", "label").agg(F.count("*").alias("texts"))
    usual = of_label.groupBy("run").agg(F.max_by("label", F.struct("texts", "label")).alias("usual"), F.count("*").alias("labels")).where("labels > 1")
    rows = cut_compact(rows.join(usual.drop("labels"), "run"))
    rare = rows.where("label <> usual").drop("usual")
    other = rows.select("run", *[F.col(c).alias(f"{c}_b") for c in ("key", "label", "n", "reach")], (F.col("label") == F.col("usual")).alias("usual_b"))
    met = (F.col("label") != F.col("label_b")) & (F.col("n") <= F.col("reach_b")) & (F.col("n_b") <= F.col("reach"))
    pairs = rare.join(other, "run").where(met & (F.col("usual_b") | (F.col("key") < F.col("key_b"))))
    return pairs.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


def near_links(keyed: DataFrame, sketched: DataFrame, least: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """Verified links (a, b) between texts (keys), enough of them to join all of a class.

    Texts with one sketch in common meet in a bucket. In each, the text that meets most others in all its
    buckets leads (a group's original meets more than its copies do) and is aligned with every other one. What is
    linked gets one label. In the next round the text that meets most after it leads in each bucket of several labels
    and is aligned with those of other labels: a group of copies costs a few alignments a member. Then
    neighbours in the order of their rarest runs are aligned, and at last all texts of buckets with several labels, linked or not, with
    those of other labels, but for pairs that cannot be similar enough.
    """
    reps = cut_compact(sketched.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    members = reps.select("key", "n", F.posexplode("sketch").alias("nth", "value")).select("key", "n", F.xxhash64("nth", "value").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = members.join(sizes, "bucket")
    meets = members.groupBy("key").agg(F.sum("size").alias("meets"))
    rows = cut_compact(members.join(meets, "key").select("bucket", "key", "n", "meets", F.lit(False).alias("led")))
    texts = _texts_of(keyed, rows.select("key").distinct().join(reps.select("key", "rep"), "key"))

    spark = keyed.sparkSession
    tried = spark.createDataFrame([], "a binary, b binary, similarity double")
    labels = spark.createDataFrame([], "key binary, label binary")
    alike = F.least("n", "leader.n") >= F.greatest("n", "leader.n") * least - 1e-9
    for _ in range(rounds):
        rows = _of_mixed(rows, labels)
        led = rows.where("not led").groupBy("bucket").agg(F.max_by(F.struct("key", "n", "label"), F.struct("meets", "key")).alias("leader"))
        rows = cut_compact(rows.join(led, "bucket"))
        pairs = rows.where((F.col("label") != F.col("leader.label")) & alike).select(F.col("key").alias("a"), F.col("leader.key").alias("b")).distinct()
        pairs = cut_compact(_untried(pairs, tried))
        if not pairs.isEmpty():
            tried = tried.unionByName(_verified(pairs, texts, least))
            labels = components(tried.where("similarity > 0"))
        rows = rows.select("bucket", "key", "n", "meets", (F.col("led") | (F.col("key") == F.col("leader.key"))).alias("led"))
        if rows.isEmpty():
            break
    prefixes = _prefixes(texts.join(_of_mixed(rows, labels).select("key").distinct(), "key"), least)
    for meet in (_neighbours, _close_pairs):
        pairs = cut_compact(_untried(meet(prefixes, labels), tried))
        if not pairs.isEmpty():
            tried = tried.unionByName(_verified(pairs, texts, least))
            if meet is _neighbours:
                labels = components(tried.where("similarity > 0"))
    return tried.where("similarity > 0")


def _of_mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels, with each text's label (its own key where it has none)."""
    rows = _labelled(rows, labels)
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return rows.join(mixed.select("bucket"), "bucket")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    both = tried.select("a", "b").union(tried.select("b", "a"))
    return pairs.join(both, ["a", "b"], "left_anti")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the least key of each key's component; keys without links are left out.

    Labels spread over links and then jump to their labels' labels, until none changes.
    """
    edges = cut_compact(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_compact(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("low")).select("key", F.least("key", "low").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "key").select("key", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("further"))
        after = cut_compact(spread.join(jump, "next").select("key", F.least("next", "further").alias("label"), (F.least("next", "further") != F.col("label")).alias("changed")))
        labels = after.select("key", "label")
        if after.where("changed").isEmpty():
            return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), class_size, found_links (of its
    text to different texts: those found until its class was whole, not all there are), key (of its text), kept.

    Documents are of one class if their texts are equal but for the case of A-Z, or linked, directly or over
    others, by an aligned similarity of their 5-word runs of ``least`` or more. Null and empty texts are equal
    texts without links; an empty table gives no rows. A null id is larger than any other. The row of the
    class's id is kept (of several with that id, the one of least key; of repeated rows, each).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = rows.withColumn("key", text_key(F.col("text")))
    sketched = cut_compact(_sketched(keyed))
    links = cut_compact(near_links(keyed, sketched, least).select("a", "b"))
    labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("found_links"))
    placed = sketched.select("doc_id", "key").join(labels.join(degree, "key", "left"), "key", "left")
    placed = cut_compact(placed.select("doc_id", "key", F.coalesce("label", "key").alias("label"), F.coalesce("found_links", F.lit(0)).cast("long").alias("found_links")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("k"))).alias("first")
    classes = placed.groupBy("label").agg(first, F.count("*").alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.k"))
    return placed.join(classes, "label").select("doc_id", F.col("first.id").alias("class_id"), "class_size", "found_links", "key", kept.alias("kept"))


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, with the same columns, whatever their names.

    Null and empty texts are one class; of repeated rows of one id and text one stays (any of them, where they differ in
    other columns); ties as in ``near_dedup``; an empty table stays empty.
    """
    found = near_dedup(docs, id_col, text_col, least)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_key(text_or_empty(text_col)).alias("key"))
    stay = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if not found.where("kept").groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["id", "key"])
    return stay.select("row.*")
