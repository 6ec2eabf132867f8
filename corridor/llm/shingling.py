"""Word shingles of whole texts as 64-bit hashes, for a batch of texts at once.

Words are runs of bytes other than 0x20 and 0x09-0x0D in UTF-8, with A-Z lower-cased. A
word's hash is a polynomial over random values of its bytes, so that one sum over a buffer
gives the hashes of all its words; a shingle's hash mixes those of its words in order.
Texts are hashed in pieces of some megabytes, cut between words: memory is bounded by the
piece, the longest word and one text's shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once.
PIECE = 1 << 20
#: Bytes of text whose sets are held at once.
SLICE = 4 << 20
_ODD = np.uint64(0xD1342543DE82EF95)
_rng = np.random.default_rng(20_240_229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE[_IS_SPACE] = 0  # white space after a word adds nothing to its sum
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers_of(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < length:
        length = max(length, PIECE)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, k)]), dtype=np.uint64) for k in (_ODD, inverse)]
    return _powers[0], _powers[1]


def _hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words in ``data``; a word also begins at each of ``begins``."""
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = begins[begins < len(data)]
    first[inner] = word[inner]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at
    up, down = _powers_of(len(data))
    sums = np.add.reduceat(_VALUE[data] * up[: len(data)], at)
    return mix(sums * down[at]), at


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, piece by piece."""
    out, begin = [], 0
    while begin < len(data):
        end = begin + PIECE
        while end < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[end - PIECE : end]])
            if len(spaces):
                end = end - PIECE + int(spaces[-1]) + 1
                break
            end += PIECE  # a word longer than a piece
        out.append(_hashes(data[begin:end], np.zeros(1, dtype=np.int64))[0])
        begin = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _chain(words: np.ndarray, size: int) -> np.ndarray:
    count = len(words) - size + 1
    out = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out + words[i : i + count])
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.empty(len(values), dtype=bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def _own(words: np.ndarray, size: int) -> np.ndarray:
    """The set of one text's words; fewer words than ``size`` make one shingle."""
    return _distinct(_chain(words, min(size, len(words)))) if len(words) else words


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; none for null texts and texts without words."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    whole = raw.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.empty(0, dtype=np.uint8)
    out: list[np.ndarray] = []
    i = 0
    while i < len(raw):
        j = i + 1
        while j < len(raw) and offsets[j + 1] - offsets[i] <= PIECE:
            j += 1
        begins = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > PIECE:
            out.append(_own(_long(part), size))
        else:
            words, at = _hashes(part, begins[:-1])
            ends = np.searchsorted(at, begins)
            chained = _chain(words, size) if len(words) >= size else words
            for a, b in zip(ends[:-1], ends[1:]):
                out.append(_distinct(chained[a : b - size + 1]) if b - a >= size else _own(words[a:b], size))
        i = j
    return out


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have ``SLICE`` bytes at most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
