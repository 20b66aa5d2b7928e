"""Encode whole texts with a public tokenizer, remembering the ids of words."""

from __future__ import annotations

import os

import numpy as np

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Words remembered by one worker; beyond that it starts afresh.
MEMO_WORDS = 500_000
JOINED_WORDS = 1000
#: A mark at a word's end is a token of its own after one of LETTERS.
MARKS = frozenset(bytes([c]) for c in b".,!?;:")
LETTERS = frozenset(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Texts of mixed scripts, case, marks and blanks whose ids tell whether words are encoded one by one.
PROBES = ("Don't SPLIT 3.14, html/5:  na\u00efve  Gr\u00f6\u00dfe;\t\u0391\u03b2\u0393 (a-b) x_y `z`!", "\u4f60\u597d\nworld  \u0130stanbul e\u0301 word. 9 lives?", "The quick brown fox, jumps over the lazy dog.")
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Numbers words as they come; new ones wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordEncoder:
    """ids of texts under a tokenizer that drops white space and lower-cases, so that a text's ids are its words' ids.

    Each distinct word goes to the library once, and one mark at a word's end goes apart from a letter or digit
    before it, as the tokenizer parts them too. A-Z are lower-cased before, but in texts with ``<|``, where
    case decides whether a special token stands there.
    """

    def __init__(self, path: str, end_id: int = END_ID, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.memo_words = end_id, memo_words
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stems: dict[bytes, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.memo = _Memo()
        self.memo[b" end "] = 0  # no word has a blank
        self.flat = np.array([self.end_id], np.uint32)
        self.first = np.array([0], np.int64)
        self.count = np.array([1], np.int64)

    def _encode_stems(self, stems: list[bytes]) -> None:
        """Words of letters are encoded many at a time: each is one pre-token, whose last id ends a word."""
        words = [s.decode("utf-8", "replace") for s in stems]
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        alone = [k for k, w in enumerate(words) if not w.isalpha()]
        groups = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join([words[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = found.ids
            last = np.flatnonzero(self.ends_word[ids]).tolist()
            if len(last) != len(group):
                alone += group
                continue
            at = 0
            for k, end in zip(group, last, strict=True):
                self.stems[stems[k]] = ids[at : end + 1]
                at = end + 1
        for k, found in zip(alone, self.tokenizer.encode_batch_fast([words[k] for k in alone], add_special_tokens=False), strict=True):
            self.stems[stems[k]] = found.ids

    def _learn(self) -> None:
        fresh, self.memo.fresh = self.memo.fresh, []
        if not fresh:
            return
        if len(self.stems) > self.memo_words:
            self.stems = {}
        parts = [(w[:-1], w[-1:]) if w[-1:] in MARKS and w[-2:-1] in LETTERS and b"<|" not in w else (w, b"") for w in fresh]
        unknown = {x for pair in parts for x in pair if x and x not in self.stems}
        if unknown:
            self._encode_stems(sorted(unknown))
        stems = self.stems
        found = [stems[a] + stems[b] if b else stems[a] for a, b in parts]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum()))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), each text ended by the end id; how many ids each text has."""
        if len(self.memo) > self.memo_words:
            self._forget()
        numbers: list[int] = []
        ends = np.empty(len(texts), np.int64)
        number = self.memo.__getitem__
        for k, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            if b"<|" not in raw:
                raw = raw.translate(_TO_LOWER)
            numbers.extend(map(number, raw.split()))
            numbers.append(0)
            ends[k] = len(numbers)
        self._learn()
        which = np.array(numbers, np.int64)
        count = self.count[which]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat(self.first[which] - (upto - count), count) + np.arange(total)]
        bounds = upto[ends - 1] if len(ends) else ends
        return ids, np.diff(bounds, prepend=0)


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """One encoder a worker and vocabulary; a tokenizer that does not tokenize word by word is refused."""
    if (path, end_id) not in _encoders:
        made = WordEncoder(path, end_id)
        for probe in PROBES:
            if made.encode([probe])[0].tolist() != [*made.tokenizer.encode(probe, add_special_tokens=False).ids, end_id]:
                raise ValueError(f"the tokenizer at {path} does not encode a text as its lower-case words, one by one")
        _encoders[path, end_id] = made
    return _encoders[path, end_id]
