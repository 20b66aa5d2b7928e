"""Secrets: known shapes, and windows of high entropy."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The shapes of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")
#: Character classes of candidates: pattern, window, bits a character that a window must reach.
CLASSES = (
    ("hex", re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])"), 20, 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.7),
)
#: Candidates that look random and are no secrets, as a whole.
ALLOWED = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),  # UUID
    re.compile(r"[A-Za-z]+(?:[/_=+-]+[A-Za-z]*)*"),  # words, paths and rules without digits
    re.compile(r"[0-9/_=+-]+"),  # numbers and dates
)
#: Pieces that tell of a made-up string. They count as one repeated character, so a window must be random beside them.
ALLOWED_PIECE = re.compile(r"example|sample|dummy|placeholder|changeme|x{6}|0123456789|abcdef", re.IGNORECASE)
MASK = "\0"


def high_entropy_spans(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged windows of ``text`` whose Shannon entropy is ``bits`` a character or more.

    Sum c * log2(c) of the window's counts is kept up as one character enters and one leaves.
    """
    if len(text) < window:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    limit = window * (math.log2(window) - bits) + 1e-9
    for end, char in enumerate(text, 1):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += weigh[c + 1] - weigh[c]
        if end > window:
            gone = text[end - window - 1]
            c = counts[gone]
            counts[gone] = c - 1
            total += weigh[c - 1] - weigh[c]
        if end >= window and total <= limit:
            if spans and end - window <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - window, end))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base scan, sorted."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the entropy scan adds outside the base ones."""
    found: set[tuple[int, int, int]] = set()
    for _, candidate, window, bits in CLASSES:
        for m in candidate.finditer(text):
            word = m.group()
            if any(a.fullmatch(word) for a in ALLOWED):
                continue
            masked = ALLOWED_PIECE.sub(lambda piece: MASK * len(piece.group()), word)
            for a, b in high_entropy_spans(masked, window, bits):
                a, b = a + m.start(), b + m.start()
                piece = text[a:b]
                if any(x.isdigit() for x in piece) and any(x.isalpha() for x in piece) and not any(s < b and a < e for s, _, e in base):
                    found.add((a, 3, b))
    return sorted(found)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str) -> tuple[int, int, int, int, str, str]:
    base = base_spans(text)
    more = entropy_spans(text, base)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *counts, len(more), hashlib.sha256(_line(base).encode()).hexdigest(), _line(sorted(base + more))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas. The
    base kinds are patterns; ``entropy`` spans are windows over candidate strings of one character class
    whose entropy reaches the class's bound, merged, holding letters and digits, outside base spans, unless
    the whole candidate is of an allowed shape; allowed pieces inside it add no entropy to their windows. One pass without a shuffle over whole texts: null and empty
    texts have no spans, repeated rows are scanned each, and an empty table gives no rows.
    """

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame([scan(t) for t in frame["text"]], columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])
            found.insert(0, "doc_id", frame["doc_id"].astype("Int64").reset_index(drop=True))
            yield found

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(scanned, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
