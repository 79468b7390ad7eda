"""Cutting texts into pre-tokens as the tokenizers library does, and encoding distinct ones with it.

The fast way cuts with the standard ``re`` module.  Its classes agree with the library's for all
characters but a few (numbers that are no decimal digits, unassigned characters, some controls);
a text with one of those is cut or encoded by the library itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Distinct words of a generation that a Python worker remembers; it keeps two generations.
MEMORY = 400_000


#: Characters seen so far whose class is the same in ``re`` as in the library.
_agreed: set[str] = set()


def _differs(c: str) -> bool:
    return unicodedata.category(c) in ("No", "Nl", "Cn", "Cs", "Co") or c in "\x1c\x1d\x1e\x1f\x85"


def is_plain(text: str) -> bool:
    """Whether ``re`` classes all characters of a text as the library does."""
    new = set(text) - _agreed
    odd = {c for c in new if _differs(c)}
    _agreed.update(new - odd)
    return not odd


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ByteLevelCutter:
    """Pre-tokens of a byte-level BPE file; special strings count as tokens of their own, as is the library's default."""

    #: Fixed value: the pattern of the byte-level pre-tokenizer, in classes of ``re``.
    PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        self.tok = load(path)
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special tokens in it."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return list(chain.from_iterable(self._cut(p) for p in parts if p)), len(parts) - 1
        return self._cut(text), 0

    def _cut(self, text: str) -> list[str]:
        if is_plain(text):
            return self.PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, pretokens: list[str]) -> list[int]:
        """Number of pieces of each pre-token."""
        return [len(e.ids) for e in self.tok.encode_batch_fast(pretokens, add_special_tokens=False)]


class WordEncoder:
    """Ids of texts under a BPE with word ends; a word goes to the library once for as long as it is remembered."""

    #: Fixed value: the split pattern of the file, in classes of ``re``.
    PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        self.tok = load(path)
        self.size = self.tok.get_vocab_size()
        self.ends = np.zeros(self.size, dtype=bool)
        for t, i in self.tok.get_vocab().items():
            self.ends[i] = t.endswith("</w>")
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return self.PATTERN.findall(text.replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without special tokens of its own."""
        plain = [not self.special.search(t) and is_plain(t) for t in texts]
        cut = [self._words(t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        wanted = set(chain.from_iterable(cut))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.older, self.known, new = self.known, {}, wanted
        kept = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in kept)
        self._learn(list(new.difference(kept)))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, ws)), dtype="<u4") for ws in cut]
        for i, ok in enumerate(plain):
            if not ok:
                out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
        return out

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, edges = ids.tobytes(), (np.concatenate(([0], stops)) * 4).tolist()
                self.known.update((w, raw[a:b]) for w, a, b in zip(part, edges, edges[1:], strict=False))
            else:
                self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True))


#: Encoders and cutters of this Python worker, which its tasks share.
_made: dict[tuple[type, str], object] = {}


def of_worker(kind: type, path: str):
    """The worker's ``kind(path)``, made once."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]
