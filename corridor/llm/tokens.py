"""Whole-text encoding with a ``tokenizers`` file, one white-space chunk at a time.

The tokenizer file used here drops white space and encodes the pieces between
independently, so a text's ids are the concatenated ids of its chunks. Chunks repeat,
so each Python worker keeps a bounded cache of chunk -> ids and asks the library only
for those it has not met. The results equal ``encode(text)``; a test holds them
against it, mixed scripts and odd white space included.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np

#: Chunks a worker keeps; full, it keeps its entries and learns no more.
CACHE_ENTRIES = 900_000
#: Characters of text encoded together.
CHARS_PER_CALL = 1_000_000
#: Words joined to one text for one call of the library.
WORDS_PER_CALL = 2_000
#: The id appended to each document.
END_ID = 2

_ENCODERS: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 16-bit ids (the vocabulary must be under 65,536).

    Lower-case words made of letters alone pass the tokenizer's normalizer and splitter
    unchanged, so they go to its model joined by spaces in one call; the token that ends
    a word carries the end-of-word mark, which parts the ids again. All other chunks go
    through the whole tokenizer, one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        if len(vocab) > 0xFFFF:
            raise ValueError("ids do not fit 16 bits")
        self.ends = np.zeros(0x10000, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        #: The library looks for these in the raw text, before it lower-cases.
        self.marks = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized]
        self.known: dict[str, bytes] = {}

    def _ask_words(self, words: list[str]) -> Iterable[bytes]:
        for at in range(0, len(words), WORDS_PER_CALL):
            some = words[at : at + WORDS_PER_CALL]
            found = self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u2")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            raw = ids.tobytes()
            if len(ends) != len(some):
                raise ValueError("a word did not end in one end-of-word token")
            start = 0
            for end in ends:
                yield raw[2 * start : 2 * end]
                start = end

    def _ask_chunks(self, chunks: list[str]) -> Iterable[bytes]:
        for found in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
            yield np.array(found.ids, dtype="<u2").tobytes()

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of chunks the cache lacks; it takes what it has room for."""
        known, words, marked, other = self.known, set(), {}, []
        for c in missing:
            if c.isalpha() and c.islower():
                words.add(c)
            elif c[-1] in ".," and c[:-1].isalpha() and c[:-1].islower():
                marked[c] = c[:-1]
            else:
                other.append(c)
        ask = [w for w in words.union(marked.values()) if w not in known]
        fresh = dict(zip(ask, self._ask_words(ask)))
        fresh.update(zip(other, self._ask_chunks(other)))
        for mark in ".,":
            if mark not in known:
                known[mark] = next(iter(self._ask_chunks([mark])))
        for c, word in marked.items():
            fresh[c] = (fresh.get(word) or known[word]) + known[c[-1]]
        if len(known) < CACHE_ENTRIES:
            known.update(fresh)
        return fresh

    def _split(self, text: str) -> list[str]:
        """The chunks of a text, in lower case where that provably commutes with the tokenizer's own steps.

        It does not where lower-casing makes an added token: the text then stays as it is.
        """
        low = text.lower()
        if not any(m in low for m in self.marks) and "Σ" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            text = low
        return [c for c in text.replace("\n", " ").split(" ") if c]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, without the end id; None is the empty text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < CHARS_PER_CALL):
                chars += len(texts[end] or "")
                end += 1
            out.extend(self._encode(texts[at:end]))
            at = end
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        get = self.known.get
        split = [self._split(t) if t else [] for t in texts]
        found: list[list[bytes | None]] = [list(map(get, s)) for s in split]
        missing: set[str] = set()
        for s, f in zip(split, found):
            if None in f:
                missing.update(c for c, ids in zip(s, f) if ids is None)
        if missing:
            fresh = self._learn(missing)
            for s, f in zip(split, found):
                if None in f:
                    f[:] = [fresh[c] if ids is None else ids for c, ids in zip(s, f)]
        return [b"".join(f) for f in found]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a file: one each, so its cache serves all tasks the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def as_u4(ids: bytes | np.ndarray) -> np.ndarray:
    """16-bit ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype="<u2").astype("<u4")


Encode = Callable[[list[str | None]], list[bytes]]
