"""Counts of the terms of whole texts, for a batch of texts at once.

A term is a run of bytes outside a set of separators (ASCII, so that runs hold whole code
points of UTF-8), with A-Z lower-cased; inside it is named by 64 bits of a hash. Texts are
taken in pieces of about a megabyte, and a longer text is cut between terms: memory is
bounded by the piece, the longest term and one text's distinct terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corridor.llm.shingling import PIECE, _powers_of, mix

#: Odd values of the bytes, the same for A-Z and a-z.
_VALUE = np.random.default_rng(13_121_112).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = _VALUE[_LOWER]


def separators(codes: set[int]) -> np.ndarray:
    """A table of the bytes that part terms."""
    found = np.zeros(256, dtype=bool)
    found[sorted(codes)] = True
    return found


#: White space: 0x20 and 0x09-0x0D.
SPACES = separators({0x20, *range(0x09, 0x0E)})
#: All of ASCII but digits and letters.
NOT_ALNUM = separators({c for c in range(0x80) if not chr(c).isalnum()})


class Terms(NamedTuple):
    """One entry for each distinct term of a text, by text; ``at`` and ``size`` are one place of it in ``data``."""

    text: np.ndarray
    term: np.ndarray
    count: np.ndarray
    at: np.ndarray
    size: np.ndarray
    data: np.ndarray

    def name(self, i: int) -> str:
        """The term of entry ``i``."""
        return _LOWER[self.data[self.at[i] : self.at[i] + self.size[i]]].tobytes().decode("utf-8")


def _pieces(data: np.ndarray, ends: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``data`` that end with a text or, in a text longer than a piece, behind a separator."""
    begin, total = 0, int(ends[-1])
    while begin < total:
        k = int(np.searchsorted(ends, begin + PIECE, side="right")) - 1
        end = int(ends[k]) if k >= 0 else 0
        if end <= begin:
            stop = int(ends[np.searchsorted(ends, begin, side="right")])
            end = min(begin + PIECE, stop)
            while end < stop:
                found = np.flatnonzero(parts[data[max(begin, end - PIECE) : end]])
                if len(found):
                    end = max(begin, end - PIECE) + int(found[-1]) + 1
                    break
                end = min(end + PIECE, stop)  # a term longer than a piece
        yield begin, end
        begin = end


def _summed(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Entries of equal text and term as one, with the sum of their counts."""
    text, term, count, at, size = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.empty(len(order), dtype=bool)
    new[:1] = True
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    firsts = np.flatnonzero(new)
    return [text[firsts], term[firsts], np.add.reduceat(count[order], firsts), at[order][firsts], size[order][firsts]]


def count_terms(texts: pa.Array, parts: np.ndarray) -> Terms:
    """The distinct terms of each text with their counts; a null text is empty."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    whole = raw.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.empty(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    ends = offsets[1:] - offsets[0]
    found: list[tuple[np.ndarray, ...]] = []
    cut = False
    for begin, end in _pieces(data, ends, parts) if len(data) else ():
        own = data[begin:end]
        inside = ~parts[own]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        bounds = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, end)] - begin
        first[bounds] = inside[bounds]  # a term ends with its text
        at = np.flatnonzero(first)
        if not len(at):
            continue
        up, down = _powers_of(end - begin)
        sums = np.add.reduceat(np.where(inside, _VALUE[own], np.uint64(0)) * up[: end - begin], at)
        sizes = np.add.reduceat(inside, at, dtype=np.int64)
        term = mix(sums * down[at])
        text = np.searchsorted(ends, at + begin, side="right")
        found.append(tuple(_summed([(text, term, np.ones(len(at), dtype=np.int64), at + begin, sizes)])))
        cut |= int(ends[np.searchsorted(ends, end)]) != end
    if not found:
        none = np.empty(0, dtype=np.int64)
        return Terms(none, none.astype(np.uint64), none, none, none, data)
    if cut:  # a text in several pieces
        return Terms(*_summed(found), data)
    return Terms(*(np.concatenate(x) for x in zip(*found)), data)
