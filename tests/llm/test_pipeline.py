"""The pipeline's row-dropping stages against brute force, and its run."""

from collections import Counter

import corpus_pipeline
from litspark.llm.common import table
from litspark.llm.near_dedup import aligned_similarity, kmers

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages_keep_one_of_each(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    exact = stages["exact"](spark, docs, SMALL).cache()
    texts = {}
    for i, t in rows:
        texts[lower(t)] = max(i, texts.get(lower(t), i))
    assert exact.columns == docs.columns
    assert Counter(r.doc_id for r in exact.collect()) == Counter(texts.values())

    left = sorted((r.doc_id, kmers(r.text)) for r in exact.select("doc_id", "text").collect())
    first = {i: i for i, _ in left}
    for n, (i, a) in enumerate(left):
        for j, b in left[:n]:
            if first[i] != first[j] and aligned_similarity(a, b) > 0:
                low, high = sorted((first[i], first[j]))
                first = {k: low if v == high else v for k, v in first.items()}
    near = stages["near"](spark, exact, SMALL)
    assert near.columns == docs.columns
    assert Counter(r.doc_id for r in near.collect()) == Counter(set(first.values()))


def test_run_has_pieces_of_kept_documents_only(spark):
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality"](spark, table(spark, SMALL, "documents"), SMALL).collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert got and {r.doc_id for r in got} <= kept


def test_stages_take_odd_rows_and_clashing_names(spark):
    """Nulls, empty and repeated rows, an empty table, and columns named as the stages' own."""
    names = ["row", "key", "nth", "id", "gone_id", "copies", "label"]
    odd = [(1, None, "a"), (2, "", "a"), (None, " \n", None), (3, "one two " * 60, "b"), (3, "one two " * 60, "b"), (4, "ONE two " * 60, None), (5, "the end", "b")]
    rows = [(*r, None, None, *range(10 * i, 10 * i + len(names))) for i, r in enumerate(odd)]
    schema = "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"`{n}` int" for n in names)
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "exact", "near", "mixed"):
        got = stages[name](spark, docs, SMALL)
        assert got.columns == docs.columns
        assert {tuple(r) for r in got.collect()} <= set(rows)
        assert stages[name](spark, none, SMALL).count() == 0
    assert stages["packed"](spark, none, SMALL).count() == 0
    assert sorted(r.doc_id or 0 for r in stages["exact"](spark, docs, SMALL).collect()) == [0, 2, 4, 5]
    assert sorted(r.doc_id or 0 for r in stages["near"](spark, docs, SMALL).collect()) == [0, 1, 3, 5]
    taken = Counter((r.doc_id, r.row) for r in stages["mixed"](spark, docs, SMALL).collect())
    assert max(taken.values()) <= 3
