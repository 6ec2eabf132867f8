"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes there is one valid encoding, so it is enough to store
the last token of it: the token ``t`` that ends there and stands stably beside the last
token of the prefix before it. Two tokens stand stably if merging their joined bytes by
rank gives those two again. ``PrefixTable`` keeps that column; appending bytes extends it,
and an edit recomputes it only from the edited byte on. Following it back from the end
gives the ids, equal to those of rank-order merging. An Aho-Corasick automaton over the
tokens lists those that end at each byte.

``encode_documents`` and ``digest_documents`` split whole texts by the pattern, encode each
distinct piece once a worker (a bounded cache) and decode the ids from the ranks.

Defined results: a null or empty text has no token; repeated rows are encoded alike; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces and token pairs a worker keeps; full, a cache starts anew. Longer pieces are not kept.
CACHE_PIECES = 1_000_000
CACHE_PAIRS = 1_000_000
CACHED_CHARS = 48
#: White space besides the blank and the line feed.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_CODECS: dict[tuple[str, str], "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Ranks:
    """A vocabulary and what the dynamic programme asks of it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        #: Finds, for each byte, the tokens that end there; without those that merging never makes.
        self.ending = ahocorasick.Automaton()
        for token, i in ranks.items():
            if len(token) == 1 or self.merge(token) == [i]:
                self.ending.add_word(token.decode("latin-1"), (len(token), i))
        self.ending.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; for the few bytes of a token or of two."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = 1 << 62, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], 1 << 62)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is how their joined bytes are encoded; kept for the next time."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def extend(self, data: bytes, last: list[int]) -> None:
        """Complete ``last``, the last token of each prefix of ``data`` (-1 for the empty one), from where it ends."""
        pairs, first = self.pairs, len(last)
        start = max(0, first - self.longest)
        last.extend([-1] * (len(data) + 1 - first))
        done = first - 1
        for at, (n, token) in self.ending.iter(data[start:].decode("latin-1")):
            end = start + at + 1
            if end <= done:
                continue
            before = last[end - n]
            if before < 0:
                ok = end == n
            else:
                ok = pairs.get(before << 32 | token)
                if ok is None:
                    ok = self.stable(before, token)
            if ok:
                last[end] = token
                done = end
        if done != len(data):
            raise ValueError("bytes that no token covers")

    def trace(self, last: list[int]) -> list[int]:
        """The ids, back from the end of a column of last tokens."""
        out, end, bytes_of = [], len(last) - 1, self.bytes_of
        while end:
            token = last[end]
            out.append(token)
            end -= len(bytes_of[token])
        return out[::-1]


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b"") -> None:
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing before them is computed again."""
        self.data += more
        if more:
            self.ranks.extend(self.data, self.last)

    def replace(self, at: int, n: int, new: bytes) -> None:
        """Put ``new`` in place of ``n`` bytes at ``at``; the prefixes up to there are kept."""
        rest = new + self.data[at + n :]
        self.data = self.data[:at]
        del self.last[at + 1 :]
        self.append(rest)

    def ids(self) -> list[int]:
        """The encoding of all bytes."""
        return self.ranks.trace(self.last)


class Codec:
    """Encodes and decodes texts; each match of the pattern separately."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = Ranks(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.letters = regex.compile(r" ?\p{L}+").fullmatch
        self.decimal = [str(i) for i in range(len(self.ranks.bytes_of))]
        #: Chunk -> its ids as 32-bit integers.
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> list[int]:
        """Ids of one match; a piece that is a token is that token."""
        data = piece.encode("utf-8")
        whole = self.ranks.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self.ranks, data).ids()

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= CACHED_CHARS:
            if len(self.known) > CACHE_PIECES:
                self.known.clear()
            self.known[chunk] = ids

    def _piece_bytes(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = np.array(self.piece(piece), dtype="<u4").tobytes()
            self._keep(piece, found)
        return found

    def _learn(self, chunk: str) -> bytes:
        """Ids of a chunk that the cache lacks."""
        if chunk[-1] in ".," and self.letters(chunk[:-1]):
            return self._piece_bytes(chunk[:-1]) + self._piece_bytes(chunk[-1])
        pieces = self.find(chunk)
        return b"".join([self._piece_bytes(p) for p in pieces])

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Parts of a text that the pattern matches independently of each other.

        Where every white space is one blank or line feed between other characters, no
        match reaches over it but one that starts with the blank.
        """
        words = [line.split(" ") for line in text.split("\n")]
        if len(text.split()) != sum(map(len, words)) or any(c in text for c in OTHER_SPACE):
            return [text]
        out: list[str] = []
        for own in words:
            out.append(own[0])
            out.extend([" " + w for w in own[1:]])
            out.append("\n")
        out.pop()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        get, learn = self.known.get, self._learn
        return np.frombuffer(b"".join([get(c) or learn(c) for c in self._chunks(text)]) if text else b"", dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids.tolist()))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the decimal ids joined by commas, sha256 of the decoded bytes."""
        ids = self.encode(text)
        joined = ",".join(map(self.decimal.__getitem__, ids.tolist()))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a file and pattern."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t.as_py() or "").astype(np.int32) for t in batch.column(1)]
            counts = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids array<int>")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: whole texts encoded and the ids decoded."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = [own.digest(t.as_py() or "") for t in batch.column(1)]
            counts, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
