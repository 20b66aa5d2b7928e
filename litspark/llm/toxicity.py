"""Toxicity as a severity grade, by cumulative-link ordinal regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Labelled documents that the model is fitted on: at most so many of either class, those of lowest hash.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
#: Words and beginnings that the model has weights for, at most: the most significant ones of the sample (a bound of the fit).
FEATURES = 1_000
#: A feature is significant if so many standard errors part its log odds in toxic and in other documents.
LEAST_Z = 4.0
#: Lengths of words' beginnings (bytes) that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
GRADES = 4
#: Shares of a text's words that are significant, from which on a rate feature is set.
RATES = (0.002, 0.005, 0.01, 0.02, 0.05)
STEPS, RATE, L1 = 600, 0.05, 2e-4
#: The decision is as low as lets this share of clean documents through when scored by a model that has not seen them.
FALSE_ALARMS, LOWEST_CUT, HIGHEST_CUT = 0.004, 0.2, 0.5
MEMO_WORDS = 200_000
# upper to lower case, and ASCII that is neither letter nor digit to a blank
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def grams(word: bytes) -> list[bytes]:
    """A word and, marked by an asterisk, its beginnings: stems count though their endings differ."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if k < len(word))]


class OrdinalModel:
    """P(grade >= k) = sigmoid(w . x - t_k): one weight a feature for all thresholds t_1 < t_2 < ...

    x has one entry for each significant word or beginning that the text holds, and for each of RATES that the share of
    words with such an entry reaches. A text is toxic if P(grade >= 1) >= ``cut``.
    """

    def __init__(self, words: list[bytes], weights: np.ndarray, thresholds: np.ndarray, cut: float = HIGHEST_CUT):
        self.words, self.weights, self.thresholds, self.cut = words, weights, thresholds, cut
        self.place = {w: i for i, w in enumerate(words)}
        self.memo: dict[bytes, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def _held(self, word: bytes) -> list[int]:
        if (found := self.memo.get(word)) is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = self.memo[word] = [self.place[g] for g in grams(word) if g in self.place]
        return found

    def features(self, text: str | None) -> list[int]:
        words = plain_words(text)
        held: set[int] = set()
        hits = 0
        for word, n in Counter(words).items():
            if found := self._held(word):
                held.update(found)
                hits += n
        share = hits / len(words) if words else 0.0
        return sorted(held) + [len(self.words) + i for i, r in enumerate(RATES) if share >= r]

    def share(self, text: str | None) -> float:
        """Share of the text's words with a significant entry."""
        words = plain_words(text)
        return sum(n for word, n in Counter(words).items() if self._held(word)) / len(words) if words else 0.0

    def at_least(self, features: list[int]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(self.thresholds - self.weights[features].sum()))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood of ``grades``, by Adam, with an L1 penalty on weights."""
    n, f = x.shape
    base = np.array([np.clip((grades >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, n_grades)])
    t = -np.log(base / (1 - base))
    # thresholds as a first one and the logs of their gaps, so that they stay in order
    params = np.concatenate([np.zeros(f), [t[0]], np.log(np.maximum(np.diff(t), 1e-2))])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        gaps = np.exp(params[f + 1 :])
        thresholds = params[f] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.ones((n, n_grades + 1))
        s[:, 1:n_grades] = 1 / (1 + np.exp(np.clip(thresholds - (x @ params[:f])[:, None], -30, 30)))
        s[:, n_grades] = 0
        here, above = s[np.arange(n), grades], s[np.arange(n), grades + 1]
        p = np.maximum(here - above, 1e-12)
        grad_t = np.zeros((n, n_grades + 1))
        grad_t[np.arange(n), grades] += here * (1 - here) / p
        grad_t[np.arange(n), grades + 1] -= above * (1 - above) / p
        by_t = grad_t[:, 1:n_grades].mean(axis=0)
        by_gap = np.array([by_t[k:].sum() for k in range(1, n_grades - 1)]) * gaps
        grad = np.concatenate([x.T @ (here + above - 1) / n + L1 * np.sign(params[:f]), [by_t.sum()], by_gap])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params = params - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return params[:f], params[f] + np.concatenate([[0], np.cumsum(np.exp(params[f + 1 :]))])


def _unfitted(words: list[bytes]) -> OrdinalModel:
    return OrdinalModel(words, np.zeros(len(words) + len(RATES)), np.zeros(GRADES - 1))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for i, held in enumerate(rows):
        x[i, held] = 1
    return x


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit the model on a bounded sample of labelled documents (labels: the id and ``toxic``, 0 or 1).

    Significant words and beginnings are those that toxic documents of the sample hold more often than others, beyond
    chance. If labels have a column ``grade`` (1 to 3 of toxic documents), it is the target. Else the sample is halved by
    the id's hash, and toxic documents are graded by thirds of the share of their words that is significant in the other
    half: no document's grade depends on features that its own label helped to choose. Likewise the decision's cut is read off scores by models of
    the other half. Of several labels of one document the most toxic counts; those without an id or document do not.
    """
    by_hash = [F.xxhash64("id"), F.col("id")]
    graded = "grade" in labels.columns
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"), (F.col("grade").cast("int") if graded else F.lit(None).cast("int")).alias("grade"))
    marks = marks.where("id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("grade").alias("grade"))
    some = marks.where("toxic = 1").orderBy(*by_hash).limit(TOXIC_ROWS).union(marks.where("toxic = 0").orderBy(*by_hash).limit(CLEAN_ROWS))
    some = some.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int"))
    sample = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), F.col("doc") == F.col("id"))
    sample = cut(sample.select("toxic", "grade", "half", "text"))

    def holds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = {group: Counter() for group in range(4)}
            for toxic, half, text in zip(frame["toxic"], frame["half"], frame["text"], strict=True):
                counts[2 * half + toxic].update({g for word in set(plain_words(text)) for g in grams(word)})
            for group, held in counts.items():
                yield pd.DataFrame({"word": list(held), "toxic": group % 2, "half": group // 2, "n": list(held.values())})

    sizes = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    of = lambda toxic, halves: sum(sizes.get((toxic, h), 0) for h in halves)
    if not of(1, (0, 1)) or not of(0, (0, 1)):
        return OrdinalModel([], np.zeros(len(RATES)), np.full(GRADES - 1, np.inf if not of(1, (0, 1)) else -np.inf))
    counted = sample.mapInPandas(holds, "word binary, toxic int, half int, n long").groupBy("word")
    n = lambda toxic, half: F.sum(F.when((F.col("toxic") == toxic) & (F.col("half") == half), F.col("n")).otherwise(0))
    counted = cut(counted.agg(*[n(t, h).alias(f"n{t}{h}") for t in (0, 1) for h in (0, 1)]).where("n10 + n11 >= 3"))

    def significant(halves: tuple[int, ...]) -> list[bytes]:
        if not of(1, halves) or not of(0, halves):
            return []
        bad, good = (sum((F.col(f"n{t}{h}") for h in halves), F.lit(0)) for t in (1, 0))
        a, b = bad + 0.5, good + 0.5
        odds = F.log(a / (of(1, halves) + 1 - a)) - F.log(b / (of(0, halves) + 1 - b))
        rows = counted.where(bad >= 3).withColumn("z", odds / F.sqrt(1 / a + 1 / b)).where(F.col("z") > LEAST_Z)
        return [bytes(r.word) for r in rows.orderBy(F.desc("z"), "word").limit(FEATURES).select("word").collect()]

    whole, halves = _unfitted(significant((0, 1))), [_unfitted(significant((h,))) for h in (0, 1)]

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            other = [halves[1 - h] for h in frame["half"]]
            yield pd.DataFrame(
                {
                    "toxic": frame["toxic"],
                    "grade": frame["grade"].astype("Int64"),
                    "half": frame["half"],
                    "x": [whole.features(t) for t in frame["text"]],
                    "x0": [halves[0].features(t) for t in frame["text"]],
                    "x1": [halves[1].features(t) for t in frame["text"]],
                    "share": [m.share(t) for m, t in zip(other, frame["text"], strict=True)],
                }
            )

    schema = "toxic int, grade long, half int, x array<int>, x0 array<int>, x1 array<int>, share double"
    rows = sorted(sample.mapInPandas(vectors, schema).toArrow().to_pylist(), key=lambda r: (r["toxic"], r["share"], r["half"], r["x"], r["x0"], r["x1"]))
    toxic, half, share = (np.array([r[c] for r in rows]) for c in ("toxic", "half", "share"))
    bounds = np.quantile(share[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (share > bounds[0]) + (share > bounds[1]), 0)
    if graded:
        grades = np.where(toxic == 1, np.clip([r["grade"] or 1 for r in rows], 1, GRADES - 1), 0)
    clean_scores = []
    for h in (0, 1):
        learnt = half == h
        if {0, 1} <= set(toxic[learnt]) and (~learnt).any():
            x = _matrix([r[f"x{h}"] for r in rows], len(halves[h].weights))
            weights, thresholds = fit_ordinal(x[learnt], grades[learnt])
            unseen = ~learnt & (toxic == 0)
            clean_scores += list(1 / (1 + np.exp(thresholds[0] - x[unseen] @ weights)))
    level = np.nextafter(np.quantile(clean_scores, 1 - FALSE_ALARMS), 1) if clean_scores else HIGHEST_CUT
    model = fit_ordinal(_matrix([r["x"] for r in rows], len(whole.weights)), grades)
    return OrdinalModel(whole.words, *model, float(np.clip(level, LOWEST_CUT, HIGHEST_CUT)))


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (expected grade, 0 to 3), p_toxic (of a grade of 1 or more), grade
    (the likeliest), toxic (p_toxic >= the model's cut).

    What ``severity`` means is as good as the grades that the model was fitted on. With labels of 0 and 1 alone it ranks how much of
    a toxic text is made of words that toxic texts use, which no one has judged; with a column ``grade`` it is the expected judgement.

    One pass over whole texts without a shuffle. Null and empty texts have no features; repeated rows are
    scored each; an empty table gives no rows.
    """

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            up = np.array([model.at_least(model.features(t)) for t in frame["text"]]).reshape(len(frame), GRADES - 1)
            shares = -np.diff(np.hstack([np.ones((len(up), 1)), up, np.zeros((len(up), 1))]), axis=1)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").to_numpy(), "severity": up.sum(axis=1), "p_toxic": up[:, 0], "grade": shares.argmax(axis=1), "toxic": up[:, 0] >= model.cut})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(scored, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labelled documents among ``docs`` and score all of them."""
    return score_toxicity(docs, fit_toxicity(docs, labels, id_col, text_col), id_col, text_col)
