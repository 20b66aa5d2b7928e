"""Cases that operators once lost, missed or paid for with the square of their input."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litspark.llm import language_model, mixing, near_dedup, quality, secrets
from litspark.llm.common import table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_allowed_piece_hides_no_key_around_it():
    rng = random.Random(1)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789ghijkmnpqrstuvwyz"
    for at in (0, 10, 16, 25, 32):
        key = "".join(rng.sample(letters, 32))
        spans = secrets.scan(f"see {key[:at]}abcdef{key[at:]} there")[5]
        assert spans.startswith("entropy:"), at
    assert secrets.scan("see EXAMPLE0123456789abcdefEXAMPLE there")[3] == 0


def test_keep_good_takes_any_column_name(spark):
    docs = table(spark, SMALL, "documents").withColumnsRenamed({"lang": "a.b", "n_chars": "__carried"})
    trusted = table(spark, SMALL, "labels").where("quality = 1")
    kept = quality.keep_good(docs, trusted)
    assert kept.columns == docs.columns
    want = quality.quality_rules(docs, trusted).where("kept").select("doc_id")
    assert sorted(kept.toPandas()["doc_id"]) == sorted(r.doc_id for r in want.collect())


def test_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    scores = []
    for known in (1 << 16, 64, 5):
        monkeypatch.setattr(language_model, "KNOWN_WORDS", known)
        scores.append({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score_documents(docs).collect()})
    assert scores[0] == scores[1] == scores[2]


def test_class_words_are_the_most_frequent(spark):
    counts = spark.createDataFrame([(bytearray(b"w%d" % i), 7) for i in range(200)] + [(bytearray(b"z"), 9)], "word binary, c long")
    assert list(language_model.class_words(counts, 4)) == [b"z", b"w0", b"w1", b"w10"]


def test_every_source_comes_near_its_target(spark):
    rows = mixing.mix(table(spark, MIDDLE, "documents")).collect()
    taken, target, sizes = Counter(), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        sizes.setdefault(r.source, []).append(r.size)
        assert r.taken <= 3 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 5), (s, taken[s], t, len(sizes[s]))


def test_few_heavy_documents_come_as_near_as_they_can():
    import numpy as np

    rng = random.Random(2)
    for seed in range(30):
        size = np.array([float(rng.randrange(200, 5000)) for _ in range(rng.randrange(2, 6))])
        ratio = rng.uniform(0, 3)
        base, part = np.full(len(size), math.floor(ratio)), np.full(len(size), ratio % 1)
        out = base + mixing.settle_heavy(size, base, part, np.random.default_rng(seed), 3)
        best = min(abs(sum(c * s for c, s in zip(copies, size)) - ratio * size.sum()) for copies in itertools.product(range(4), repeat=len(size)))
        assert set(out) <= {0, 1, 2, 3}
        assert abs((out * size).sum() - ratio * size.sum()) <= max(best, mixing.NEAR * ratio * size.sum()) + 1e-6


def test_templated_texts_are_not_all_paired(spark, monkeypatch):
    """Texts of one form, six of whose words come from pools of six: most pairs share a rare run, few are alike."""
    rng = random.Random(9)
    form = [f"f{i}" for i in range(120)]
    texts = set()
    while len(texts) < 500:
        words = list(form)
        for k in range(6):
            words[10 + 20 * k] = f"v{k}x{rng.randrange(6)}"
        texts.add(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string")
    aligned = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *more: aligned.append(pairs.count()) or verified(pairs, *more))
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    runs = {i: near_dedup.kmers(t) for i, t in enumerate(sorted(texts))}
    first = {i: i for i in runs}
    for i, j in itertools.combinations(runs, 2):
        if first[i] != first[j] and near_dedup.aligned_similarity(runs[i], runs[j]) > 0:
            low, high = sorted((first[i], first[j]))
            first = {k: low if v == high else v for k, v in first.items()}
    assert got == first
    assert sum(aligned) <= 60 * len(texts), aligned
