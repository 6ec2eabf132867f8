"""Progressive JPEG media columns in numpy.

``decode_many`` reads progressive JPEGs (one or three components): every scan, spectral
selection and successive approximation alike, adds to arrays of coefficients; these are
dequantised, inverse-transformed, chroma is repeated to full resolution and RGB tensors
come out. The streams between restart markers are independent, so they are decoded in step:
each numpy operation handles one symbol of all of them, over all images of a call.

``encode_many`` writes bytes as coefficients, the format's own unit, one payload block of 64
bytes a coefficient block, into a 4:2:0 image of two DC and three AC scans a component; so
bytes come back exactly, which quantised samples could not promise.

``write_media`` and ``read_media`` apply both to a table.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal media and
features (the transform is exact in integers); an empty table gives an empty result; other
columns are ignored. A file that is no progressive JPEG raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Blocks between restart markers, and payload bytes handled at once.
RESTART = 2
CHUNK_BYTES = 1 << 20
#: Scans of a component: first and last coefficient, earlier and own bit position.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))
#: Place in a row-major block of each coefficient in zigzag order, by its rule.
ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _basis() -> np.ndarray:
    """Inverse transform of zigzag coefficients to row-major samples, in units of 2^-13."""
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    full = np.einsum("ua,vb->uvab", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 8192)


_BASIS = _basis()


class Huffman:
    """A table from its counts of codes by length (1 to 16) and its symbols."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.segment = bytes(counts) + bytes(symbols)
        self.length = np.zeros(1 << 16, dtype=np.uint8)
        self.symbol = np.zeros(1 << 16, dtype=np.uint8)
        self.code_of, self.bits_of = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        code = at = 0
        for bits, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                low = code << (16 - bits)
                self.length[low : low + (1 << (16 - bits))] = bits
                self.symbol[low : low + (1 << (16 - bits))] = s
                self.code_of[s], self.bits_of[s] = code, bits
                code += 1
            at += n
            code <<= 1


def _table(short: dict[int, list[int]], rest: int, symbols: list[int]) -> Huffman:
    """Named symbols get short codes, all others codes of ``rest`` bits."""
    named = {s for group in short.values() for s in group}
    groups = dict(short) | {rest: [s for s in symbols if s not in named]}
    ordered = [groups.get(bits, []) for bits in range(1, 17)]
    return Huffman(bytes(map(len, ordered)), bytes(s for g in ordered for s in g))


_DC = _table({2: [0, 5], 3: [4, 6]}, 5, list(range(12)))
_AC = _table({3: [6], 4: [5, 7, 4, 0], 5: [3, 2, 1], 6: [0xF0]}, 9, [r << 4 | s for r in range(16) for s in range(11)])


# ---------------------------------------------------------------- writing


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _with_magnitude(table: Huffman, symbol: np.ndarray, v: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.where(v < 0, v + (1 << size) - 1, v)
    return (table.code_of[symbol] << size) | low, table.bits_of[symbol] + size


def _dc_first(v: np.ndarray, lane: np.ndarray, al: int) -> tuple[np.ndarray, ...]:
    v = v[:, 0].astype(np.int64) >> al
    d = v.copy()
    same = lane[1:] == lane[:-1]
    d[1:] -= np.where(same, v[:-1], 0)
    s = _size(d)
    return (np.arange(len(v)), *_with_magnitude(_DC, s, d, s))


def _ac_first(v: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, ...]:
    band = v[:, ss : se + 1].astype(np.int64)
    band = np.sign(band) * (np.abs(band) >> al)
    blk, k = np.nonzero(band)
    x = band[blk, k]
    before = np.full(len(k), -1)
    before[1:] = np.where(blk[1:] == blk[:-1], k[:-1], -1)
    run = k - before - 1
    size = _size(x)
    code, bits = _with_magnitude(_AC, (run % 16) << 4 | size, x, size)
    order = blk * 256 + k * 2 + 1
    long = np.repeat(np.arange(len(k)), run // 16)  # a run of 16 zeros has a symbol of its own
    last = np.full(len(v), -1)
    last[blk] = k
    open_ = np.flatnonzero(last < se - ss)
    codes = [code, np.full(len(long), _AC.code_of[0xF0]), np.full(len(open_), _AC.code_of[0])]
    widths = [bits, np.full(len(long), _AC.bits_of[0xF0]), np.full(len(open_), _AC.bits_of[0])]
    keys = np.concatenate([order, order[long] - 1, open_ * 256 + 255])
    turn = np.argsort(keys, kind="stable")
    return keys[turn] >> 8, np.concatenate(codes)[turn], np.concatenate(widths)[turn]


def _ac_refine(v: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, ...]:
    """Blocks where no coefficient becomes non-zero are one end symbol and correction bits."""
    mag = np.abs(v[:, ss : se + 1].astype(np.int64)) >> al
    old = mag > 1
    fresh = (mag == 1).any(axis=1)
    plain = np.flatnonzero(~fresh)
    full = plain[old[plain].all(axis=1)]
    part = plain[~old[plain].all(axis=1)]
    blocks, order, codes, widths = [plain], [np.zeros(len(plain))], [np.full(len(plain), _AC.code_of[0])], [np.full(len(plain), _AC.bits_of[0])]
    bit = mag & 1
    for at in range(0, se - ss + 1, 16):
        own = bit[full, at : at + 16]
        weights = 1 << np.arange(own.shape[1] - 1, -1, -1)
        blocks.append(full)
        order.append(np.full(len(full), at + 1))
        codes.append(own @ weights)
        widths.append(np.full(len(full), own.shape[1]))
    i, k = np.nonzero(old[part])
    blocks.append(part[i])
    order.append(k + 1)
    codes.append(bit[part[i], k])
    widths.append(np.ones(len(k), dtype=np.int64))
    for b in np.flatnonzero(fresh).tolist():
        items = list(_refine_block(mag[b].tolist(), v[b, ss : se + 1].tolist()))
        blocks.append(np.full(len(items), b))
        order.append(np.arange(len(items)))
        codes.append(np.array([c for c, _ in items]))
        widths.append(np.array([w for _, w in items]))
    where, code, bits = np.concatenate(blocks), np.concatenate(codes), np.concatenate(widths)
    turn = np.lexsort((np.concatenate(order), where))
    return where[turn], code[turn], bits[turn]


def _refine_block(mag: list[int], v: list[int]) -> Iterator[tuple[int, int]]:
    """Codes and widths of one block in which coefficients become non-zero."""
    last = max(i for i, m in enumerate(mag) if m == 1)
    zeros, held = 0, []
    for i, m in enumerate(mag[: last + 1]):
        if m > 1:
            held.append((m & 1, 1))
        elif m == 1:
            s = zeros << 4 | 1
            yield int(_AC.code_of[s]), int(_AC.bits_of[s])
            yield int(v[i] > 0), 1
            yield from held
            zeros, held = 0, []
        else:
            zeros += 1
            if zeros == 16:
                yield int(_AC.code_of[0xF0]), int(_AC.bits_of[0xF0])
                yield from held
                zeros, held = 0, []
    if last + 1 < len(mag):
        yield int(_AC.code_of[0]), int(_AC.bits_of[0])
        yield from ((m & 1, 1) for m in mag[last + 1 :] if m > 1)


def _pack(block: np.ndarray, code: np.ndarray, bits: np.ndarray, lane: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes, with stuffing and restart markers, and where each lane begins.

    ``lane`` is that of each block; ``first`` tells whether a lane is its scan's first, else its marker number plus one.
    """
    own = lane[block]
    n = len(first)
    total = np.bincount(own, weights=bits, minlength=n).astype(np.int64)
    size = (total + 7) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    run = np.cumsum(bits) - bits
    start_of = np.concatenate([[0], np.cumsum(total)])[:-1]
    at = base[own] * 8 + run - start_of[own]
    wide = code.astype(np.uint64) << (40 - bits - (at & 7)).astype(np.uint64)
    out = np.zeros(base[-1] + 8)
    for j in range(5):
        part = (wide >> np.uint64(32 - 8 * j)) & np.uint64(255)
        out += np.bincount((at >> 3) + j, weights=part, minlength=len(out))
    data = out[: base[-1]].astype(np.uint8)
    slack = size * 8 - total
    data[base[1:] - 1] |= ((1 << slack) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(data == 255) + 1
    marked = np.flatnonzero(first > 0)
    where = np.concatenate([stuffed, base[marked], base[marked]])
    what = np.concatenate([np.zeros(len(stuffed)), np.full(len(marked), 255), 0xD0 + (first[marked] - 1) % 8]).astype(np.uint8)
    turn = np.argsort(where, kind="stable")
    ends = base[1:] + np.searchsorted(where[turn], base[1:], side="left")
    # what stands at a lane's end: stuffing of its last byte belongs to it, the next lane's marker to the next
    ends += np.isin(base[1:], stuffed)
    return np.insert(data, where[turn], what[turn]), np.concatenate([[0], ends])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    tables = b"\x00" + _DC.segment + b"\x10" + _AC.segment
    return b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC2, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", RESTART))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (a positive multiple of 64 bytes)."""
    planes: list[list[np.ndarray]] = [[], [], []]
    heads = []
    for p in payloads:
        n_mcu = -(-len(p) // 384)
        wide = int(np.ceil(np.sqrt(n_mcu)))
        high = -(-n_mcu // wide)
        v = np.zeros((high, wide, 6, 64), dtype=np.int8)
        v.reshape(-1)[: len(p)] = np.frombuffer(p, dtype=np.int8)
        planes[0].append(v[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64))
        planes[1].append(v[:, :, 4].reshape(-1, 64))
        planes[2].append(v[:, :, 5].reshape(-1, 64))
        heads.append(_head(16 * wide, 16 * high) + _segment(0xFE, struct.pack(">Q", len(p))))
    bodies: list[list[bytes]] = [[] for _ in payloads]
    for c, own in enumerate(planes):
        counts = np.array([len(x) for x in own])
        v = np.concatenate(own)
        lanes = -(-counts // RESTART)
        base = np.concatenate([[0], np.cumsum(lanes)])
        lane = np.repeat(base[:-1], counts) + (np.arange(len(v)) - np.repeat(np.cumsum(counts) - counts, counts)) // RESTART
        first = np.arange(base[-1]) - np.repeat(base[:-1], lanes)
        for ss, se, ah, al in SCANS:
            if ss:
                block, code, bits = _ac_refine(v, ss, se, al) if ah else _ac_first(v, ss, se, al)
            elif ah:
                block, code, bits = np.arange(len(v)), (v[:, 0].astype(np.int64) >> al) & 1, np.ones(len(v), dtype=np.int64)
            else:
                block, code, bits = _dc_first(v, lane, al)
            data, ends = _pack(block, code, bits, lane, first)
            raw = data.tobytes()
            header = _segment(0xDA, bytes((1, c + 1, 0, ss, se, ah << 4 | al)))
            for i, (a, b) in enumerate(zip(ends[base[:-1]].tolist(), ends[base[1:]].tolist())):
                bodies[i].append(header + raw[a:b])
    return [b"".join((h, *body, b"\xff\xd9")) for h, body in zip(heads, bodies)]


# ---------------------------------------------------------------- reading


@dataclass
class Image:
    """The segments of a file."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)  # what a scan is, to group by
    data: list[tuple[int, int]] = field(default_factory=list)
    raw: bytes = b""
    comment: bytes = b""

    @property
    def mcus(self) -> tuple[int, int]:
        """Columns and rows of the grid of minimum coded units."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


_TABLES: dict[bytes, Huffman] = {}


def _huffman(segment: bytes) -> Huffman:
    if segment not in _TABLES:
        if len(_TABLES) > 256:
            _TABLES.clear()
        _TABLES[segment] = Huffman(segment[:16], segment[16:])
    return _TABLES[segment]


def parse(raw: bytes) -> Image:
    """The structure of a progressive JPEG."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, at, tables, restart = Image(raw=raw), 2, {}, 0
    while raw[at + 1] != 0xD9:
        marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            out.height, out.width = struct.unpack(">HH", body[1:5])
            out.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("no progressive JPEG")
        elif marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                out.quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            n = body[0]
            ids = [c[0] for c in out.components]
            which = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get((body[2 + 2 * i] & 15 | 0x10) if ss else body[2 + 2 * i] >> 4, b"") for i in range(n))
            found = _NEXT_MARKER.search(raw, at)
            end = found.start() if found else len(raw)
            out.scans.append((which, ss, se, a >> 4, a & 15, used, restart))
            out.data.append((at, end))
            at = end
    return out


class _Bits:
    """Bit readers, one a lane, over the joined streams of a scan."""

    def __init__(self, streams: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(streams), dtype=np.uint8)
        sizes = np.array([len(s) for s in streams])
        starts = np.cumsum(sizes) - sizes
        after = np.append(raw[1:], 0)
        last = np.zeros(len(raw), dtype=bool)
        last[(starts + sizes - 1)[sizes > 0]] = True
        ff = (raw == 255) & ~last
        stuffing, marker = np.flatnonzero(ff & (after == 0)) + 1, np.flatnonzero(ff & (after >= 0xD0) & (after <= 0xD7))
        keep = np.ones(len(raw), dtype=bool)
        keep[stuffing] = keep[marker] = keep[marker + 1] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        begin = np.sort(np.concatenate([starts, marker + 2]), kind="stable")
        self.position = place[begin] * 8
        #: Lanes of each stream.
        self.lanes = np.diff(np.append(np.searchsorted(begin, starts, side="left"), len(begin)))
        data = np.concatenate([raw[keep], np.full(16, 255, dtype=np.uint8)]).astype(np.uint64)
        word = np.zeros(len(data) - 8, dtype=np.uint64)
        for j in range(8):
            word |= data[j : j + len(word)] << np.uint64(56 - 8 * j)
        self.word, self.byte = word, data.astype(np.uint8)

    def peek(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next ``n`` (up to 48) bits at each position."""
        at = np.minimum(at, (len(self.word) - 1) * 8)
        shifted = self.word[at >> 3] << (at & 7).astype(np.uint64)
        return ((shifted >> np.uint64(1)) >> (63 - np.asarray(n)).astype(np.uint64)).astype(np.int64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _units(image: Image, which: tuple[int, ...], offsets: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Component and block of each unit of a scan in coded order, and units in an MCU."""
    comp, block, per = _places(tuple(image.components), image.width, image.height, which)
    return comp, block + np.array(offsets)[comp] if len(which) > 1 else block + offsets[which[0]], per


@lru_cache(maxsize=256)
def _places(components: tuple, width: int, height: int, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """``_units`` of an image whose blocks begin at 0."""
    hm, vm = max(x[1] for x in components), max(x[2] for x in components)
    cols, rows = -(-width // (8 * hm)), -(-height // (8 * vm))
    if len(which) == 1:
        c = which[0]
        _, h, v, _ = components[c]
        wide, high = -(-width * h // (8 * hm)), -(-height * v // (8 * vm))
        blocks = (np.arange(high)[:, None] * (cols * h) + np.arange(wide)).reshape(-1)
        return np.full(len(blocks), c), blocks, 1
    comps, parts = [], []
    for c in which:
        _, h, v, _ = components[c]
        y = np.arange(rows)[:, None, None, None] * v + np.arange(v)[None, None, :, None]
        x = np.arange(cols)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
        parts.append((y * (cols * h) + x).reshape(rows * cols, v * h))
        comps.append(np.full((rows * cols, v * h), c))
    return np.concatenate(comps, axis=1).reshape(-1), np.concatenate(parts, axis=1).reshape(-1), sum(p.shape[1] for p in parts)


def _scan(images: list[Image], j: int, coefs: list[np.ndarray], offsets: list[list[int]]) -> None:
    """Add scan ``j`` of all images to the coefficients."""
    which, ss, se, ah, al, used, restart = images[0].scans[j]
    bits = _Bits([im.raw[im.data[j][0] : im.data[j][1]] for im in images])
    comp, block, begin, count = [], [], [], []
    at = 0
    for im, off, n_lanes in zip(images, offsets, bits.lanes.tolist()):
        c, b, per = _units(im, which, off)
        step = restart * per if restart else len(b)
        firsts = np.arange(0, max(len(b), 1), max(step, 1))
        if len(firsts) != n_lanes:
            raise ValueError("restart markers do not fit the image")
        comp.append(c)
        block.append(b)
        begin.append(at + firsts)
        count.append(np.diff(np.append(firsts, len(b))))
        at += len(b)
    comp, block, begin, count = (np.concatenate(x) for x in (comp, block, begin, count))
    tables = [_huffman(u) for u in used] if ss or not ah else []
    if ss == 0:
        _dc_scan(bits, comp, block, begin, count, which, tables, coefs, ah, al)
    elif ah:
        _ac_refine_scan(bits, block, begin, count, tables[0], coefs[which[0]], ss, se, al)
    else:
        _ac_first_scan(bits, block, begin, count, tables[0], coefs[which[0]], ss, se, al)


def _dc_scan(bits, comp, block, begin, count, which, tables, coefs, ah, al) -> None:
    pos = bits.position.copy()
    pred = np.zeros((len(pos), max(which) + 1), dtype=np.int64)
    for i in range(int(count.max(initial=0))):
        lane = np.flatnonzero(count > i)
        unit = begin[lane] + i
        for t, c in enumerate(which):
            own = lane[comp[unit] == c]
            if not len(own):
                continue
            where = block[begin[own] + i]
            if ah:
                coefs[c][where, 0] |= (bits.peek(pos[own], 1) << al).astype(np.int16)
                pos[own] += 1
                continue
            code = bits.peek(pos[own], 16)
            n, s = tables[t].length[code].astype(np.int64), tables[t].symbol[code].astype(np.int64)
            pred[own, c] += _extend(bits.peek(pos[own] + n, s), s)
            pos[own] += n + s
            coefs[c][where, 0] = pred[own, c] << al


def _ac_first_scan(bits, block, begin, count, table, coef, ss, se, al) -> None:
    pos, unit, end = bits.position.copy(), begin.copy(), begin + count
    k, skip = np.full(len(pos), ss), np.zeros(len(pos), dtype=np.int64)
    flat = coef.reshape(-1)
    while True:
        live = unit < end
        if not live.all():
            pos, unit, end, k, skip = pos[live], unit[live], end[live], k[live], skip[live]
            if not len(pos):
                return
        code = bits.peek(pos, 16)
        n, rs = table.length[code].astype(np.int64), table.symbol[code].astype(np.int64)
        if skip.any():
            waiting = skip > 0
            n, rs = np.where(waiting, 0, n), np.where(waiting, 0, rs)
        r, s = rs >> 4, rs & 15
        some = s > 0
        k += np.where(some, r, 0)
        more = np.where(some, s, np.where(r < 15, r, 0))
        extra = bits.peek(pos + n, more)
        pos += n + more
        at = block[unit] * 64 + k
        flat[at[some]] = _extend(extra[some], s[some]) << al
        zrl = ~some & (r == 15)
        ended = ~some & ~zrl
        if ended.any():
            skip = np.where(ended, np.where(skip > 0, skip - 1, (1 << np.minimum(r, 14)) + extra - 1), skip)
        k += np.where(zrl, 16, 1)
        over = ended | (k > se)
        unit += over
        k[over] = ss


def _ac_refine_scan(bits, block, begin, count, table, coef, ss, se, al) -> None:
    pos, unit, end = bits.position.copy(), begin.copy(), begin + count
    k, skip = np.full(len(pos), ss), np.zeros(len(pos), dtype=np.int64)
    index = np.arange(ss, se + 1)
    while True:
        live = unit < end
        if not live.all():
            pos, unit, end, k, skip = pos[live], unit[live], end[live], k[live], skip[live]
            if not len(pos):
                return
        code = bits.peek(pos, 16)
        waiting = skip > 0
        n, rs = np.where(waiting, 0, table.length[code]).astype(np.int64), np.where(waiting, 0, table.symbol[code]).astype(np.int64)
        r, s = rs >> 4, rs & 15
        pos += n
        fresh = s > 0
        ended = ~fresh & (r < 15)
        more = np.where(fresh, 1, np.where(ended, r, 0))
        extra = bits.peek(pos, more)
        pos += more
        skip = np.where(ended, np.where(waiting, skip - 1, (1 << np.minimum(r, 14)) + extra - 1), skip)
        own = coef[block[unit], ss : se + 1]
        after = index[None, :] >= k[:, None]
        zeros = np.cumsum(after & (own == 0), axis=1)
        hit = zeros > np.where(ended, 64, r)[:, None]
        stop = np.where(hit.any(axis=1), hit.argmax(axis=1), se + 1 - ss)
        fix = after & (own != 0) & (np.arange(se + 1 - ss)[None, :] < stop[:, None])
        order = np.cumsum(fix, axis=1)
        where = np.minimum(pos[:, None] + order - 1, len(bits.byte) * 8 - 1)
        one = fix & ((bits.byte[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1 > 0)
        own = own + (np.sign(own) * one << al).astype(np.int16)
        put = np.flatnonzero(fresh & (stop <= se - ss))
        own[put, stop[put]] = np.where(extra[put] > 0, 1 << al, -(1 << al))
        coef[block[unit], ss : se + 1] = own
        pos += order[:, -1]
        k = stop + 1 + ss
        over = ended | (k > se)
        unit += over
        k[over] = ss


@dataclass
class Decoded:
    """Coefficients of each component (blocks in raster order, zigzag within) and the RGB tensor."""

    width: int
    height: int
    coefficients: list[np.ndarray]
    rgb: np.ndarray
    comment: bytes


def decode_many(files: list[bytes]) -> list[Decoded]:
    """All images, those with alike scans together."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, im in enumerate(parsed):
        groups.setdefault((tuple(im.components), tuple(im.scans)), []).append(i)
    out: list[Decoded | None] = [None] * len(files)
    for members in groups.values():
        images = [parsed[i] for i in members]
        shape = [[(im.mcus[1] * v, im.mcus[0] * h) for _, h, v, _ in im.components] for im in images]
        totals, offsets = [0] * len(images[0].components), []
        for s in shape:
            offsets.append(list(totals))
            totals = [t + a * b for t, (a, b) in zip(totals, s)]
        coefs = [np.zeros((t, 64), dtype=np.int16) for t in totals]
        for j in range(len(images[0].scans)):
            _scan(images, j, coefs, offsets)
        for i, im, s, off in zip(members, images, shape, offsets):
            own = [c[o : o + a * b] for c, o, (a, b) in zip(coefs, off, s)]
            out[i] = Decoded(im.width, im.height, own, _rgb(im, own, s), im.comment)
    return out


def _plane(coef: np.ndarray, quant: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Samples of a component; sums of integers in float64 are exact, so equal blocks give equal samples."""
    v = (coef * quant).astype(np.float64) @ _BASIS
    samples = np.clip(np.floor(v / 8192 + 128.5), 0, 255).astype(np.uint8)
    return samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def _rgb(im: Image, coefs: list[np.ndarray], shape: list[tuple[int, int]]) -> np.ndarray:
    """Full-resolution RGB: chroma repeated, colours converted in units of 2^-16."""
    hm, vm = max(c[1] for c in im.components), max(c[2] for c in im.components)
    planes = []
    for (_, h, v, q), own, (rows, cols) in zip(im.components, coefs, shape):
        plane = _plane(own, im.quantisation[q], rows, cols)
        planes.append(plane.repeat(vm // v, axis=0).repeat(hm // h, axis=1)[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y = planes[0].astype(np.int32) << 16
    cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((im.height, im.width, 3), dtype=np.uint8)
    for i, x in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        out[:, :, i] = np.clip((y + x + half) >> 16, 0, 255)
    return out


def payload_of(image: Decoded) -> bytes:
    """The bytes that ``encode_many`` stored."""
    (n,) = struct.unpack(">Q", image.comment)
    high, wide = image.height // 16, image.width // 16
    v = np.empty((high, wide, 6, 64), dtype=np.int8)
    v[:, :, :4] = image.coefficients[0].reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, 64)
    v[:, :, 4], v[:, :, 5] = (c.reshape(high, wide, 64) for c in image.coefficients[1:])
    return v.tobytes()[:n]


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean colours in thousandths and mean difference of neighbouring rows in thousandths."""
    n = rgb.shape[0] * rgb.shape[1]
    means = [int(x) * 1000 // n for x in rgb.sum(axis=(0, 1), dtype=np.int64)]
    green = rgb[:, :, 1].astype(np.int16)
    rough = int(np.abs(green[1:] - green[:-1]).sum(dtype=np.int64)) * 1000 // n
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{means[0]}:{means[1]}:{means[2]}:{rough}"


# ---------------------------------------------------------------- tables


def _chunks(sizes: list[int]) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= CHUNK_BYTES):
            total += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def write_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text, as UTF-8 padded with zero bytes, in a JPEG."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            sizes = [len(x) if x is not None else 0 for x in (t.as_buffer() for t in texts)]
            for part in _chunks(sizes):
                raw = [x or b"" for x in texts[part].to_pylist()]
                media = encode_many([x + bytes((-len(x)) % 64 or (0 if x else 64)) for x in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(sizes[part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and the feature of every stored image, from its bytes alone."""
    id_type = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2)
            for part in _chunks([len(x.as_buffer()) for x in stored]):
                files = stored[part].to_pylist()
                rows = []
                for f, image in zip(files, decode_many(files)):
                    own = payload_of(image)
                    rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature_of(image.rgb)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], *columns], ["doc_id", "n_bytes", *names])

    kind = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {id_type}, {kind}")


def read_tensors(media: DataFrame) -> DataFrame:
    """``doc_id, width, height, rgb``: full-resolution tensors, three bytes a pixel."""
    id_type = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(1)
            for part in _chunks([len(x.as_buffer()) for x in stored]):
                images = decode_many(stored[part].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array([i.width for i in images], pa.int32()), pa.array([i.height for i in images], pa.int32()), pa.array([i.rgb.tobytes() for i in images], pa.binary())],
                    ["doc_id", "width", "height", "rgb"],
                )

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {id_type}, width int, height int, rgb binary")
