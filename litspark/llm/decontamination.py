"""Benchmark decontamination: winnowed fingerprints of test items found again in documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, text_or_empty

#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A window has so many words; a fingerprint is the least hash of its runs of ``GRAM`` words.
WINDOW = 10
GRAM = 4
#: Bits of each filter, whatever the number of items.
FILTER_BITS = 1 << 24
MEMO_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Fingerprints:
    """Word hashes of texts, and the winnowed fingerprints and window hashes over them."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        """The words of each lower-cased text, and the hashes of all, one after another."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo, split = self.memo, [WORDS.findall(t) for t in texts]
        flat: list[int] = []
        for words in split:
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            flat += [memo[w] for w in words]
        return split, np.array(flat, np.uint64)

    @staticmethod
    def runs(hashes: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of ``n`` hashes."""
        out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            out = (out ^ hashes[k : k + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
        return out

    @staticmethod
    def least(grams: np.ndarray, n: int) -> np.ndarray:
        """The least of each ``n`` successive hashes: the winnowed fingerprint of each window."""
        out = grams[: max(0, len(grams) - n + 1)].copy()
        for k in range(1, n):
            np.minimum(out, grams[k : k + len(out)], out=out)
        return out


def _filter_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FILTER_BITS)).astype(np.int64)


def _item_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, n, window, print_bit, window_bit) for each window of each item."""
    prints = Fingerprints()
    for frame in frames:
        split, hashes = prints.words(frame["text"].tolist())
        out, at = [], 0
        for item, words in zip(frame["item"], split, strict=True):
            n, own = min(WINDOW, len(words)), hashes[at : at + len(words)]
            at += len(words)
            if not n:
                continue
            whole = prints.runs(own, n)
            # a short item has one window, found by the hash of all its words
            marks = prints.least(prints.runs(own, GRAM), WINDOW - GRAM + 1) if n == WINDOW else whole
            out += [(item, n, " ".join(words[k : k + n]), p, w) for k, (p, w) in enumerate(zip(_filter_bits(marks).tolist(), _filter_bits(whole).tolist(), strict=True))]
        yield pd.DataFrame(out, columns=["item", "n", "window", "print_bit", "window_bit"])


def _bits(windows: DataFrame, bit: str) -> np.ndarray:
    """The filter of ``bit``: it comes to the driver as at most FILTER_BITS / 64 numbers, whatever the items."""
    words = windows.select(F.floor(F.col(bit) / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("bits"))
    rows = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()
    packed = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        packed[r["at"]] = r["bits"]
    return packed.view(np.uint64)


def _in_filter(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(FILTER_BITS)
    return (packed[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _document_windows(filters) -> callable:
    """Scans documents for windows whose fingerprint, and then whose whole, passes the filters."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints()
        for frame in frames:
            for from_ in range(0, len(frame), 500):
                yield scan_some(prints, frame.iloc[from_ : from_ + 500])

    def scan_some(prints: Fingerprints, frame: pd.DataFrame) -> pd.DataFrame:
        split, hashes = prints.words(frame["text"].tolist())
        ends = np.cumsum([len(w) for w in split])
        found: list[dict[str, list[int]]] = [{} for _ in split]
        grams = prints.runs(hashes, GRAM)
        for n, (fingerprints, wholes) in filters.value.items():
            whole = prints.runs(hashes, n)
            if n == WINDOW:
                places = np.flatnonzero(_in_filter(fingerprints, prints.least(grams, WINDOW - GRAM + 1)))
                places = places[_in_filter(wholes, whole[places])]
            else:
                places = np.flatnonzero(_in_filter(wholes, whole))
            doc = np.searchsorted(ends, places, side="right")
            inside = places + n <= ends[doc] if len(places) else np.zeros(0, bool)
            for d, p in zip(doc[inside].tolist(), places[inside].tolist(), strict=True):
                k = p - int(ends[d]) + len(split[d])
                found[d].setdefault(" ".join(split[d][k : k + n]), []).append(k)
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"].astype("Int64"),
                "text_key": frame["text_key"],
                "n_words": [len(w) for w in split],
                "windows": [[{"window": w, "starts": s} for w, s in f.items()] for f in found],
            }
        )

    return scan


def _covered(spans: Column) -> Column:
    """Words inside any of the (start, end) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(sofar: Column, span: Column) -> Column:
        return F.struct((sofar["n"] + F.greatest(F.lit(0).cast("long"), span["stop"] - F.greatest(sofar["upto"], span["start"]))).alias("n"), F.greatest(sofar["upto"], span["stop"]).alias("upto"))

    return F.aggregate(F.sort_array(spans), zero, add, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Texts are lower-cased (A-Z) and cut into words. A document's word is hit inside an occurrence of any ``WINDOW``
    successive words of an item (all its words, if it has fewer); n_items counts the items with such windows, items_sha256 is
    the SHA-256 of their ids, sorted as strings and joined by commas; ``spans`` are the hit windows' (start, stop) in words.

    Winnowing: each window keeps the least hash of its ``GRAM``-word runs, so equal windows keep equal fingerprints, and every
    span of ``WINDOW`` words or more that a document shares with an item is found. A bitmap of the items' fingerprints, of fixed
    size, picks the documents' windows that may match, and a second one those whose extension to the whole window may; what is left
    is joined on the window's words themselves, so hashes decide nothing. Only such windows are shuffled, a row for each
    distinct one of a document. A window that many documents and many items share meets as a class of items (the windows
    with the same items), and digests are taken for each distinct set of classes, not for each document and item.

    Null and empty texts have no words; an item without words is nowhere; items that repeat an id count once, and a null id counts
    as no item, though its windows hit. Repeated documents give a row each. An empty table of items leaves every
    document clean; an empty table of documents gives no rows.
    """
    spark = docs.sparkSession
    told = items.select(F.col(item_col).cast("string").alias("item"), ascii_lower(text_or_empty(item_text_col)).alias("text"))
    windows = cut(told.mapInPandas(_item_windows, "item string, n int, window string, print_bit long, window_bit long").distinct())
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]
    filters = spark.sparkContext.broadcast({n: (_bits(windows.where(F.col("n") == n), "print_bit"), _bits(windows.where(F.col("n") == n), "window_bit")) for n in sizes})

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(text).alias("text"), F.sha2(text, 256).alias("text_key"))
    scanned = cut(rows.mapInPandas(_document_windows(filters), "doc_id long, text_key string, n_words long, windows array<struct<window:string,starts:array<int>>>"))
    key = ["doc_id", "text_key"]

    # windows with the same items are one class; the id of a class is the hash of its items' list
    listed = windows.groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    classes = cut(listed.select("window", "n", "items", F.sha2(F.to_json("items"), 256).alias("class")))
    once = scanned.where(F.size("windows") > 0).dropDuplicates(key)
    hits = once.select(*key, F.explode("windows").alias("w")).select(*key, "w.window", "w.starts").join(classes.select("window", "n", "class"), "window")
    spans = F.transform("starts", lambda s: F.struct(s.cast("long").alias("start"), (s + F.col("n")).cast("long").alias("stop")))
    per_doc = hits.groupBy(*key).agg(F.array_distinct(F.sort_array(F.flatten(F.collect_list(spans)))).alias("spans"), F.sort_array(F.collect_set("class")).alias("classes"))
    per_doc = cut(per_doc)

    kinds = per_doc.select("classes").distinct().select("classes", F.explode("classes").alias("class"))
    members = classes.select("class", F.explode("items").alias("item")).distinct()
    found = kinds.join(members, "class").groupBy("classes").agg(F.sort_array(F.collect_set("item")).alias("found"))
    digests = found.select("classes", F.size("found").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "found"), 256).alias("items_sha256"))
    told = per_doc.join(digests, "classes", "left").select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), _covered(F.col("spans")).alias("n_hit"), "n_items", "items_sha256", "spans")
    both = scanned.join(told, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
    )
