"""Decontamination against brute force over every window."""

import hashlib
import re
from collections import Counter

import pyarrow.parquet as pq
from litspark.llm.decontamination import contamination

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(None if i is None else str(i))
    want = Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])] - {None}
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return want


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in docs], "doc_id long, text string, window int, item string, starts array<int>")
    b = spark.createDataFrame([(i, t, "y", 3) for i, t in items], "item_id long, text string, doc_id string, n int")
    return contamination(d, b)


def test_given_tables(spark):
    read = lambda name, key: list(zip(*[pq.read_table(f"{SMALL}/{name}.parquet")[c].to_pylist() for c in (key, "text")], strict=True))
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    assert Counter(tuple(r)[:6] for r in found(spark, docs, items).collect()) == brute(docs, items)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    items = [(1, passage), (2, passage.upper()), (2, "short Item, here"), (10, "one"), (11, None), (12, "..."), (None, "only of no item"), (13, "a a a a a a a a a a a a"), (14, " ".join(passage.split()[5:16]) + " z")]
    docs = [
        (1, None),
        (2, ""),
        (3, "x " * 50_000 + passage + " é" * 30_000),
        (4, passage[: len(passage) // 2] + " ? " + passage),
        (4, passage[: len(passage) // 2] + " ? " + passage),
        (None, "Only.of-no item; one two"),
        (5, "short item"),
        (6, "here SHORT item here short item here"),
        (7, "a " * 400 + "b"),
        (8, " ".join(passage.split()[:9])),
        (9, " ".join(passage.split()[3:13])),
        (10, "p1 p2 p3\x00p4 p5 p6 p7 p8 p9 p10"),
    ]
    assert Counter(tuple(r)[:6] for r in found(spark, docs, items).collect()) == brute(docs, items)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found(spark, docs, items).collect() if r.doc_id in (6, 9)}
    assert spans == {6: [(1, 4), (4, 7)], 9: [(0, 10)]}


def test_windows_across_documents_are_none(spark):
    assert sum(r.n_hit for r in found(spark, [(1, "a b c d e"), (2, "f g h i j")], [(1, "a b c d e f g h i j")]).collect()) == 0


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]).count() == 0
    assert [(r.n_words, r.contaminated) for r in found(spark, [(1, "a b")], []).collect()] == [(2, False)]


def test_every_long_shared_span_is_found(spark):
    """Spans of ten words at any place of a text that shares nothing else."""
    item = [f"k{i}" for i in range(300)]
    docs = [(k, " ".join(["u"] * (k % 13) + item[k : k + 10] + ["v"] * (k % 7))) for k in range(290)]
    got = {r.doc_id: r.n_hit for r in found(spark, docs, [(1, " ".join(item))]).collect()}
    assert got == dict.fromkeys(range(290), 10)
