"""A log-bilinear language model, trained with noise-contrastive estimation, that scores documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Classes that the network predicts: the most frequent words, each by itself, and groups of the others by ending.
WORD_CLASSES, GROUPS = 64, 64
CLASSES = WORD_CLASSES + GROUPS
CONTEXT = 2
#: Most frequent words whose counts are broadcast; those of other words are joined.
KNOWN_WORDS = 1 << 16
#: Distinct words one task holds before it passes their counts on.
HELD_WORDS = 400_000
WIDTH, NOISE, STEPS, RATE, SEED = 24, 32, 120, 0.1, 3
#: The end of a text as a word; words hold no blanks.
END = b" "
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2"
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").translate(_TO_LOWER).split()
    words.append(END)
    return words


def group_of(word: bytes) -> int:
    return WORD_CLASSES + zlib.crc32(word[-2:]) % GROUPS


class _Places(dict):
    """A word's class and log10(count + 1), the latter NaN where the count is to be joined."""

    def __init__(self, classes: dict[bytes, int], counts: dict[bytes, int]):
        super().__init__({w: (classes[w] if w in classes else group_of(w), float(np.log10(c + 1.0))) for w, c in counts.items()})
        self.own = len(self)

    def __missing__(self, word: bytes) -> tuple[int, float]:
        if len(self) > self.own + HELD_WORDS:
            for w in list(self)[self.own :]:
                del self[w]
        self[word] = place = (group_of(word), np.nan)
        return place


class LogBilinear:
    """Predicts a token's class from those before it: softmax over classes of (sum_i C_i r_i) . q + b."""

    def __init__(self, r: np.ndarray, c: np.ndarray, q: np.ndarray, b: np.ndarray):
        self.r, self.c, self.q, self.b = r, c, q, b

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probabilities of each class after each context, by batched matrix products."""
        near = [self.r @ c.T for c in self.c]  # CLASSES x WIDTH for each place before the token
        predicted = (near[1][:, None, :] + near[0][None, :, :]).reshape(-1, self.r.shape[1])
        logits = predicted @ self.q.T + self.b
        logits -= logits.max(axis=1, keepdims=True)
        return (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.log(10)


def train(keys: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> LogBilinear:
    """Fit the network to counted (second last, last, next) classes by noise-contrastive estimation.

    Each step tells every counted token of the corpus from ``NOISE`` noise classes, drawn by the classes' shares: a
    score counts against log(NOISE * share of the class). There are so few classes that noise is taken in expectation,
    and tokens by their counts, so nothing is sampled: a step's gradient is that of all training tokens. Adam.
    """
    rng = np.random.default_rng(SEED)
    n = CLASSES
    r = rng.normal(0, 0.1, (n, WIDTH))
    params = [r, np.stack([np.eye(WIDTH)] * CONTEXT) * 0.5, rng.normal(0, 0.1, (n, WIDTH)), np.zeros(n)]
    if not len(keys):
        return LogBilinear(*params)
    seen = np.bincount(keys, counts, n**3).reshape(n * n, n)
    share = seen.sum(axis=0) + 1.0
    share /= share.sum()
    params[3] = np.log(share)
    log_noise = np.log(NOISE * share).astype(np.float32)
    seen /= seen.sum()
    both = (seen + NOISE * seen.sum(axis=1, keepdims=True) * share).astype(np.float32)
    seen = seen.astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        r, c, q, b = params
        near = [(r @ m.T).astype(np.float32) for m in c]
        predicted = (near[1][:, None, :] + near[0][None, :, :]).reshape(-1, WIDTH)
        q32 = q.astype(np.float32)
        error = predicted @ q32.T
        error += b.astype(np.float32) - log_noise
        np.minimum(-error, 80, out=error)
        np.exp(error, out=error)
        error += 1
        np.divide(both, error, out=error)
        error -= seen
        g_predicted = (error @ q32).reshape(n, n, WIDTH)
        g_near = [g_predicted.sum(axis=0, dtype=np.float64), g_predicted.sum(axis=1, dtype=np.float64)]
        g_c = np.stack([g.T @ r for g in g_near])
        g_r = sum(g @ m for g, m in zip(g_near, c, strict=True))
        rate = RATE * (1 - 0.9 * step / steps)
        for i, g in enumerate((g_r, g_c, error.T @ predicted, error.sum(axis=0))):
            m, v = moments[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[i] = params[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LogBilinear(*params)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``rows``; tasks count before words are shuffled."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                held.update(words_of(text))
                if len(held) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(held), "c": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "c": list(held.values())})

    return rows.select("text").mapInPandas(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most ``most`` words with their counts, most frequent first: all that occur some times or more.

    How often that is shows a histogram of a few hundred classes of counts, so no task sorts words.
    """
    size = F.floor(F.log2("c") * 16).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["size"]):
        held += r.n
        if held > most:
            break
        least = r["size"]
    if least is None:
        return {}
    found = counts.where(size >= least).toArrow().to_pydict()
    return dict(sorted(zip(map(bytes, found["word"]), found["c"], strict=True), key=lambda w: (-w[1], w[0])))


def class_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The ``most`` words with the highest counts (ties by bytes), with them: an exact top-k, merged from each partition's own."""
    return {bytes(r.word): r.c for r in counts.orderBy(F.desc("c"), "word").limit(most).collect()}


def context_counts(rows: DataFrame, places) -> DataFrame:
    """(key, n): how often each class follows each pair of classes; CLASSES**3 keys at most."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = places()
        total = np.zeros(CLASSES**3, np.int64)
        for frame in frames:
            for at in range(0, len(frame), 256):
                total += np.bincount(_keys([words_of(t) for t in frame["text"].iloc[at : at + 256]], place)[0], minlength=CLASSES**3)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"key": found.astype(np.int32), "n": total[found]})

    return rows.select("text").mapInPandas(counted, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _keys(texts: list[list[bytes]], place: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens: key of (second last, last, own) class, own class, log10(count + 1); and where texts end.

    Before a text stands the end of another.
    """
    got = place.__getitem__
    found = [got(w) for words in texts for w in words]
    own = np.array([f[0] for f in found], np.int64)
    logs = np.array([f[1] for f in found], np.float64)
    ends = np.cumsum([len(w) for w in texts])
    first = ends - np.array([len(w) for w in texts])
    end_class = place[END][0]
    last = np.concatenate([[end_class], own[:-1]])
    far = np.concatenate([[end_class, end_class], own[:-2]])[: len(own)]
    last[first] = end_class
    far[first] = end_class
    second = first[ends - first > 1] + 1
    far[second] = end_class
    return (far * CLASSES + last) * CLASSES + own, own, logs, ends


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are counted over every training document, and so are their class triples, from whose counts the
    network is trained: each of its steps weighs every training token. log10 P(word) is the network's class given
    the two classes before it, plus, for a word that is no class by itself, its add-one share of its group. The words that are classes are
    the most frequent ones (ties by bytes). Counts of up to ``KNOWN_WORDS`` frequent words are broadcast, those of the others are
    joined, so no vocabulary has to fit a task, and that bound changes no result. Columns of other names are left aside. Documents with
    crc32(id) mod 7 = 2 are held out (null ids never). Null texts are one end; repeated rows are scored each;
    an empty table gives no rows; without training documents every count is 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    training = rows.where("not held_out")
    counts = cut(word_counts(training))
    top = class_words(counts, WORD_CLASSES)
    if END not in top:
        top = {END: 0, **dict(list(top.items())[: WORD_CLASSES - 1])}
    classes = {w: i for i, w in enumerate(top)}
    known = frequent_words(counts, KNOWN_WORDS) | top
    group = (F.pmod(F.crc32(F.substring(F.col("word"), -2, 2)), F.lit(GROUPS)) + WORD_CLASSES).cast("int").alias("class")
    own = [bytearray(w) for w in classes]
    sizes = counts.select("c", F.when(F.col("word").isin(own), -1).otherwise(group).alias("class")).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    total = sum(r.n for r in sizes)
    distinct = sum(r.v for r in sizes)
    group_log = np.zeros(CLASSES)
    for r in sizes:
        if r["class"] >= 0:
            group_log[r["class"]] = np.log10(r.n + r.v + 1)
    broadcast = docs.sparkSession.sparkContext.broadcast((classes, known))

    def places() -> _Places:
        return _Places(*broadcast.value)

    triples = context_counts(training, places).orderBy("key").toArrow()
    model = train(triples["key"].to_numpy().astype(np.int64), triples["n"].to_numpy().astype(np.float64))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, table = places(), model.log10_table().reshape(-1)
        for frame in frames:
            for at in range(0, len(frame), 256):
                some = frame.iloc[at : at + 256]
                texts = [words_of(t) for t in some["text"]]
                keys, own_class, logs, ends = _keys(texts, place)
                starts = np.concatenate([[0], ends[:-1]])
                joined = np.isnan(logs)
                logs = np.where(joined, 0.0, logs)
                grouped = own_class >= WORD_CLASSES
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].astype("Int64").to_numpy(),
                        "held_out": some["held_out"].to_numpy(),
                        "n_tokens": ends - starts,
                        "known": np.add.reduceat((logs > 0).astype(np.int64), starts),
                        "logs": np.add.reduceat(logs, starts),
                        "net": np.add.reduceat(table[keys] + np.where(grouped, logs - group_log[own_class], 0.0), starts),
                        "rest": [[w for w, j in zip(words, joined[a:b], strict=True) if j] for words, a, b in zip(texts, starts, ends, strict=True)],
                    }
                )

    per_doc = cut(rows.mapInPandas(scored, "doc_id long, held_out boolean, n_tokens long, known long, logs double, net double, rest array<binary>")).withColumn("row", F.monotonically_increasing_id())
    rest = per_doc.select("row", F.explode("rest").alias("word")).join(counts, "word")
    rest = rest.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    more, found = F.coalesce("more_logs", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return per_doc.drop("rest").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + found).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("net") + more).alias("score"),
    )
