"""Media columns: progressive JPEG, coded and decoded for many images at once.

The decoder accumulates the scans of a progressive file (spectral selection and successive
approximation) into coefficient arrays, transforms them back in exact integer arithmetic,
upsamples chroma and gives full-resolution RGB tensors. Entropy-coded data is read in
lockstep: every restart interval of every image of a batch is a lane, and one numpy step
decodes a symbol of all lanes. Files without restart intervals have a lane per scan.

The encoder writes such files from quantised coefficients, so that any bytes survive as
they are: a payload byte is one coefficient (less OFFSET) of a 4:2:0 image.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotagraph.llm.shared import bounded, utf8

#: What a payload byte is less as a coefficient; bytes about it are rare in texts, and
#: coefficients of -1, 0 and 1 are those that refinement scans code at length.
OFFSET = 91
#: Payload bytes in one frame; longer payloads are sequences of frames.
FRAME = 1 << 18
#: Payload bytes that are coded or decoded at once.
AT_ONCE = 3 << 18

# The zigzag order of an 8 by 8 block, by walking its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))


def _lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code lengths of the encoder's two tables, by rule: short where texts put most."""
    dc = dict.fromkeys(range(12), 4)
    ac = {r << 4 | s: 9 for r in range(16) for s in range(11)}
    ac |= dict.fromkeys((0x02, 0x03, 0x04, 0x05), 3) | dict.fromkeys((0x00, 0x01, 0x06, 0x07, 0x08), 5)
    return dc, ac


def _canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The DHT body (counts and symbols) of code lengths, and codes and lengths by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        codes[s], sizes[s], last = code, lengths[s], lengths[s]
        code += 1
    return counts + bytes(order), codes, sizes


DC_LENGTHS, AC_LENGTHS = _lengths()
DC_BODY, DC_CODES, DC_SIZES = _canonical(DC_LENGTHS)
AC_BODY, AC_CODES, AC_SIZES = _canonical(AC_LENGTHS)
EOB, ZRL = 0x00, 0xF0


@lru_cache(64)
def _lookup(body: bytes) -> np.ndarray:
    """For every 16 bits: symbol << 5 | length of the code that they begin with; 0: none."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for s in body[at : at + body[n - 1]]:
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = s << 5 | n
            code += 1
        at += body[n - 1]
        code <<= 1
    return out


# ---------------------------------------------------------------- encoding


def _magnitude(v: np.ndarray) -> np.ndarray:
    """Binary digits of |v|."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size: v, or v less one in ones' complement if negative."""
    return np.where(v < 0, v + (np.int64(1) << size) - 1, v)


def _pack_symbols(interval: np.ndarray, value: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the intervals one after the other, each filled up with ones; bytes by interval."""
    bits = np.bincount(interval, size, n).astype(np.int64)
    nbytes = (bits + 7) >> 3
    base = np.cumsum(nbytes) - nbytes << 3
    at = np.cumsum(size) - size
    first = np.cumsum(bits) - bits
    at += (base - first)[interval]
    fill = (nbytes << 3) - bits
    at, value, size = (np.concatenate(x) for x in ((at, base + bits), (value, (np.int64(1) << fill) - 1), (size, fill)))
    word, off = at >> 5, at & 31
    high = value << (63 - off - size)  # below bit 63, so that no sign is in the way
    n_words = int(nbytes.sum() + 3 >> 2) + 2
    words = np.bincount(word, (high >> 31).astype(np.float64), n_words) + np.bincount(word + 1, ((high & 0x7FFFFFFF) << 1).astype(np.float64), n_words)
    return words.astype(np.uint32).astype(">u4").view(np.uint8)[: int(nbytes.sum())], nbytes


def _framed(data: np.ndarray, nbytes: np.ndarray, per_image: np.ndarray) -> list[bytes]:
    """Entropy-coded segments of the images: stuffed, with restart markers between intervals."""
    ends = np.cumsum(nbytes)
    last = np.zeros(len(nbytes), bool)
    last[np.cumsum(per_image) - 1] = True
    number = np.arange(len(nbytes)) - np.repeat(np.cumsum(per_image) - per_image, per_image)
    full = data == 0xFF
    after = np.zeros(len(data), np.int64)
    after[ends[~last] - 1] = 2
    after += full
    place = np.arange(len(data)) + np.cumsum(after) - after
    out = np.zeros(len(data) + int(after.sum()), np.uint8)
    out[place] = data
    mark = place[ends[~last] - 1] + 1 + full[ends[~last] - 1]
    out[mark] = 0xFF
    out[mark + 1] = 0xD0 + number[~last] % 8
    cuts = np.concatenate(([0], (place[ends[last] - 1] + 1 + full[ends[last] - 1])))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _first_ac(c: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """A first scan of bands lo..hi of blocks (one per interval): bytes, bytes by interval."""
    v = c[:, lo : hi + 1]
    v = np.sign(v) * (np.abs(v) >> low)
    block, k = np.nonzero(v)
    v = v[block, k].astype(np.int64)
    start = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
    run = k - np.where(start, 0, np.concatenate(([0], k[:-1] + 1))) if len(k) else k
    size = _magnitude(v)
    symbol = (run & 15) << 4 | size
    value = AC_CODES[symbol] << size | _extra(v, size)
    bits = AC_SIZES[symbol] + size
    width = hi - lo + 1
    reach = np.zeros(len(c), np.int64)
    reach[block] = k + 1  # ascending k: the last stays
    short = np.flatnonzero(reach < width)
    longs = np.flatnonzero(run > 15)
    if not len(longs) and not len(short):
        return _pack_symbols(block, value, bits, len(c))
    order = block * 256 + k * 2 + 1
    more = np.repeat(longs, run[longs] >> 4)
    parts = [
        (order, block, value, bits),
        (order[more] - 1, block[more], np.full(len(more), AC_CODES[ZRL]), np.full(len(more), AC_SIZES[ZRL])),
        (short * 256 + 255, short, np.full(len(short), AC_CODES[EOB]), np.full(len(short), AC_SIZES[EOB])),
    ]
    order, block, value, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(order, kind="stable")
    return _pack_symbols(block[order], value[order], bits[order], len(c))


def _refine_ac(c: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """A refinement scan of one bit of bands lo..hi of blocks (one per interval)."""
    v = c[:, lo : hi + 1]
    a = np.abs(v) >> low
    width, n = hi - lo + 1, len(c)
    old, new = a > 1, a == 1
    held = np.cumsum(old, 1)
    # events: new coefficients, and the sixteenth of every run of zeros before the last of them
    block, k = np.nonzero(new)
    code, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.zeros(n, np.int64)  # bits of symbols by block
    shift = None
    if len(block):
        rows = np.unique(block)
        sub_new, sub_old = new[rows], old[rows]
        still = ~sub_old & ~sub_new & (np.arange(width) < width - np.argmax(sub_new[:, ::-1], 1)[:, None])
        zeros = np.cumsum(still, 1)
        base = np.maximum.accumulate(np.where(sub_new, zeros, 0), 1)
        run = zeros - np.concatenate((np.zeros((len(rows), 1), base.dtype), base[:, :-1]), 1)  # zeros since the last new one
        sixteenth = still & (run % 16 == 0)
        e_row, e_k = np.nonzero(sub_new | sixteenth)
        is_new = sub_new[e_row, e_k]
        symbol = np.where(is_new, (run[e_row, e_k] % 16) << 4 | 1, ZRL)
        positive = (v[rows][e_row, e_k] > 0).astype(np.int64)
        code = np.where(is_new, AC_CODES[symbol] << 1 | positive, AC_CODES[symbol])
        size = AC_SIZES[symbol] + is_new
        first = np.concatenate(([True], e_row[1:] != e_row[:-1]))
        before = np.where(first, -1, np.concatenate(([0], e_k[:-1])))  # the event before, in the block
        added = np.zeros((len(rows), width + 1), np.int64)
        np.add.at(added, (e_row, before + 1), size)
        last_k = np.zeros(len(rows), np.int64)
        last_k[e_row] = e_k
        tail = last_k < width - 1
        added[np.flatnonzero(tail), last_k[tail] + 1] += AC_SIZES[EOB]
        shift = np.cumsum(added[:, :width], 1)
        symbols[rows] = added[:, :width].sum(1) + added[:, width]
    plain = np.ones(n, bool)
    if len(block):
        plain[rows] = False
    symbols[plain] = AC_SIZES[EOB]
    bits = symbols + held[:, -1]
    nbytes = (bits + 7) >> 3
    base_bit = np.cumsum(nbytes) - nbytes << 3
    out = np.ones(int(nbytes.sum()) * 8, np.uint8)
    place = held - 1 + base_bit[:, None]
    place[plain] += AC_SIZES[EOB]
    if len(block):
        place[rows] += shift
    out[place[old]] = (a[old] & 1).astype(np.uint8)

    def put(at: np.ndarray, code: np.ndarray, size: np.ndarray) -> None:
        for j in range(int(size.max(initial=0))):
            own = size > j
            out[at[own] + j] = code[own] >> (size[own] - 1 - j) & 1

    if len(block):
        prior = np.where(before >= 0, held[rows][e_row, np.maximum(before, 0)], 0)
        sums = np.cumsum(size) - size
        start = sums - np.repeat(sums[first], np.diff(np.concatenate((np.flatnonzero(first), [len(first)]))))
        put(base_bit[rows][e_row] + prior + start, code, size)
        t = np.flatnonzero(tail)
        total = np.bincount(e_row, size, len(rows)).astype(np.int64)
        put(base_bit[rows][t] + held[rows][t, last_k[t]] + total[t], np.full(len(t), AC_CODES[EOB]), np.full(len(t), AC_SIZES[EOB]))
    p = np.flatnonzero(plain)
    put(base_bit[p], np.full(len(p), AC_CODES[EOB]), np.full(len(p), AC_SIZES[EOB]))
    return np.packbits(out), nbytes


#: Scans of the encoder after the first: component (None: all), bands, high and low bit.
SCANS = [(None, 0, 0, 0, 1), *((c, *b) for c in range(3) for b in ((1, 31, 0, 1), (32, 63, 0, 1))), *((c, 1, 63, 1, 0) for c in range(3)), (None, 0, 0, 1, 0)]


def grid(n_blocks: int) -> tuple[int, int]:
    """Rows and columns of minimum coded units (six blocks each) for so many blocks."""
    units = max(1, -(-n_blocks // 6))
    columns = max(1, int(units**0.5))
    return -(-units // columns), columns


def encode_payloads(payloads: list[bytes], note: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 file for every payload (multiples of 64 bytes), with a comment."""
    shapes = [grid(len(p) // 64) for p in payloads]
    units = np.array([r * c for r, c in shapes])
    blocks = np.zeros((int(units.sum()) * 6, 64), np.int16)
    starts = np.cumsum(units * 6) - units * 6
    for p, s in zip(payloads, starts.tolist(), strict=True):
        blocks[s : s + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - OFFSET
    y, cb, cr = ([np.arange(s + a * u, s + b * u) for s, u in zip(starts.tolist(), units.tolist(), strict=True)] for a, b in ((0, 4), (4, 5), (5, 6)))
    own = [np.concatenate(x) for x in (y, cb, cr)]
    per = [units * 4, units, units]
    # units of the interleaved scans: four luma blocks and two chroma blocks each
    inter = []
    for (rows, columns), s, u in zip(shapes, starts.tolist(), units.tolist(), strict=True):
        r, c = np.divmod(np.arange(u), columns)
        luma = s + (2 * r[:, None] + [0, 0, 1, 1]) * 2 * columns + 2 * c[:, None] + [0, 1, 0, 1]
        inter.append(np.concatenate((luma, np.stack((s + 4 * u + np.arange(u), s + 5 * u + np.arange(u)), 1)), 1))
    inter = np.concatenate(inter)
    segments = []
    for component, lo, hi, high, low in SCANS:
        if component is None:
            dc = blocks[inter, 0].astype(np.int64)
            interval = np.repeat(np.arange(len(inter)), 6)
            if high:
                data = _pack_symbols(interval, (dc >> low & 1).ravel(), np.ones(dc.size, np.int64), len(inter))
            else:
                dc >>= low
                diff = dc.copy()
                diff[:, 1:4] -= dc[:, 0:3]
                diff = diff.ravel()
                size = _magnitude(diff)
                data = _pack_symbols(interval, DC_CODES[size] << size | _extra(diff, size), DC_SIZES[size] + size, len(inter))
            segments.append(_framed(*data, units))
        else:
            coder = _refine_ac if high else _first_ac
            segments.append(_framed(*coder(blocks[own[component]].astype(np.int32), lo, hi, low), per[component]))
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    tables = part(0xDB, b"\x00" + b"\x01" * 64) + part(0xC4, b"\x00" + DC_BODY) + part(0xC4, b"\x10" + AC_BODY) + part(0xDD, struct.pack(">H", 1))
    heads = []
    for component, lo, hi, high, low in SCANS:
        ids = (0, 1, 2) if component is None else (component,)
        heads.append(part(0xDA, bytes([len(ids)]) + b"".join(bytes([i + 1, 0]) for i in ids) + bytes([lo, hi, high << 4 | low])))
    out = []
    for i, ((rows, columns), text) in enumerate(zip(shapes, note, strict=True)):
        frame = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"\xff\xd8" + part(0xFE, text) + tables + part(0xC2, frame) + b"".join(h + s[i] for h, s in zip(heads, segments, strict=True)) + b"\xff\xd9")
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[bytes, bytes]]
    lo: int
    hi: int
    high: int
    low: int
    restart: int
    data: bytes


@dataclass
class Image:
    height: int = 0
    width: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[np.ndarray] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    end: int = 0


class MediaError(ValueError):
    pass


#: What ends a scan's data: a marker other than a stuffed byte or a restart.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def parse(raw: bytes, at: int = 0) -> Image:
    """The segments of one progressive file that begins at ``at``."""
    if raw[at : at + 2] != b"\xff\xd8":
        raise MediaError("no image begins here")
    out, at, restart = Image(), at + 2, 0
    quant: dict[int, np.ndarray] = {}
    huffman: dict[int, bytes] = {}
    ids: list[int] = []
    chosen: list[int] = []
    while True:
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise MediaError("a marker is missing")
        marker = raw[at + 1]
        if marker == 0xD9:
            out.end = at + 2
            break
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise MediaError("a segment is cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xC2:
            precision, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or n not in (1, 3) or not out.height or not out.width:
                raise MediaError("only 8-bit images of one or three components")
            for k in range(n):
                i, s, q = body[6 + 3 * k : 9 + 3 * k]
                ids.append(i)
                out.sampling.append((s >> 4, s & 15))
                chosen.append(q)
            if n == 1:
                out.sampling = [(1, 1)]
            if any(not 1 <= x <= 4 or m % x for s in out.sampling for x, m in zip(s, map(max, zip(*out.sampling)))):
                raise MediaError("sampling factors that do not divide the largest")
        elif marker == 0xDA:
            if not out.sampling:
                raise MediaError("a scan without a frame")
            n = body[0]
            components = [ids.index(body[1 + 2 * k]) for k in range(n)]
            tables = [(huffman.get(body[2 + 2 * k] >> 4, b""), huffman.get(16 | body[2 + 2 * k] & 15, b"")) for k in range(n)]
            lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
            stop = _MARKER.search(raw, at)
            if not stop:
                raise MediaError("a scan is cut off")
            end = stop.start()
            out.scans.append(Scan(components, tables, lo, hi, bits >> 4, bits & 15, restart, raw[at:end]))
            at = end
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise MediaError("not a progressive Huffman image")
    if not out.scans:
        raise MediaError("no scan")
    out.quant = [quant[q] for q in chosen]
    return out


def _geometry(image: Image) -> list[tuple[int, int, int, int]]:
    """For each component: block rows and columns of its padded grid, and those it covers."""
    hm, vm = (max(s[i] for s in image.sampling) for i in (0, 1))
    rows, columns = -(-image.height // (8 * vm)), -(-image.width // (8 * hm))
    return [(rows * v, columns * h, -(-(-(-image.height * v // vm)) // 8), -(-(-(-image.width * h // hm)) // 8)) for h, v in image.sampling]


class _Bits:
    """Entropy-coded segments of several scans: unstuffed bytes, and where intervals begin."""

    def __init__(self, segments: list[bytes]):
        raw = np.frombuffer(b"".join(segments), np.uint8)
        after = np.append(raw[1:], np.uint8(0))
        full = raw == 0xFF
        marker = full & (after >= 0xD0) & (after <= 0xD7)
        drop = marker.copy()
        drop[1:] |= marker[:-1] | full[:-1] & (raw[1:] == 0)
        kept = np.cumsum(~drop)
        ends = np.cumsum([len(s) for s in segments])
        seg_start = ends - [len(s) for s in segments]
        at = np.flatnonzero(marker)
        raw_start = np.sort(np.concatenate((seg_start, at + 2)))
        before = np.concatenate(([0], kept))
        self.start = before[raw_start] << 3
        self.count = np.searchsorted(raw_start, ends) - np.searchsorted(raw_start, seg_start)
        self.data = np.concatenate((raw[~drop], np.full(16, 0xFF, np.uint8)))
        self.end = np.append(self.start[1:], np.int64(kept[-1] if len(kept) else 0) << 3)
        self.view = np.ndarray((len(self.data) - 7,), ">u8", self.data.data, 0, (1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each bit position on; the last seven may be missing."""
        at = np.minimum(at, (len(self.view) << 3) - 1)
        return self.view[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)


_U = np.uint64


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value of ``size`` bits that follow a code."""
    return np.where(bits < (np.int64(1) << np.maximum(size - 1, 0)), bits - (np.int64(1) << size) + 1, bits)


def _after(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` bits after the first ``skip``."""
    return ((window << skip.astype(_U)) >> _U(1) >> (63 - n).astype(_U)).astype(np.int64)


def _decode_first_ac(coef: np.ndarray, seq: np.ndarray, lane: np.ndarray, stop: np.ndarray, bits: _Bits, scan: Scan, bad: np.ndarray) -> None:
    table = _lookup(scan.tables[0][1])
    at, block, k = bits.start.copy(), lane.copy(), np.full(len(lane), scan.lo)
    who = np.arange(len(lane))
    flat = coef.reshape(-1)
    row = seq[block] * 64
    while len(at):
        window = bits.window(at)
        found = table[(window >> _U(48)).astype(np.int64)]
        length, symbol = (found & 31).astype(np.int64), (found >> 5).astype(np.int64)
        size, run = symbol & 15, symbol >> 4
        end = (size == 0) & (run < 15)
        n = np.where(end, run, size)
        value = _after(window, length, n)
        at += length + n
        put = k + run
        wrong = (length == 0) | (size > 0) & (put > scan.hi) | (at > bits.end[who])
        if wrong.any():
            bad[who[wrong]] = True
            size = np.where(wrong, 0, size)
            end = end & ~wrong
        if size.all():
            flat[row + put] = _extended(value, size) << scan.low
        else:
            s = np.flatnonzero(size)
            flat[row[s] + put[s]] = _extended(value[s], size[s]) << scan.low
        k = put + 1
        over = (k > scan.hi) | end | wrong
        if over.any():
            block += np.where(end, (np.int64(1) << run) + np.where(end, value, 0), 1) * over
            k[over] = scan.lo
            block[wrong] = stop[wrong]
            live = block < stop
            if not live.all():
                at, block, k, who, stop = (x[live] for x in (at, block, k, who, stop))
            row = seq[block] * 64


def _decode_refine_ac(coef: np.ndarray, seq: np.ndarray, lane: np.ndarray, stop: np.ndarray, bits: _Bits, scan: Scan, bad: np.ndarray) -> None:
    table = _lookup(scan.tables[0][1])
    at, block, k = bits.start.copy(), lane.copy(), np.full(len(lane), scan.lo)
    who, left = np.arange(len(lane)), np.zeros(len(lane), np.int64)  # left: blocks of an end-of-band run
    each = np.arange(64)
    single = np.unpackbits(bits.data)
    one = 1 << scan.low
    while len(at):
        window = bits.window(at)
        found = table[(window >> _U(48)).astype(np.int64)]
        length, symbol = (found & 31).astype(np.int64), (found >> 5).astype(np.int64)
        size, run = symbol & 15, symbol >> 4
        running = left > 0
        end = ~running & (size == 0) & (run < 15)
        n = np.where(running, 0, np.where(end, run, size))
        value = _after(window, length, n)
        wrong = ~running & ((length == 0) | (size > 1))
        at += np.where(running, 0, length + n)
        left += np.where(end, (np.int64(1) << run) + value, 0)
        whole = left > 0
        rows = coef[seq[block]]
        inside = (each >= k[:, None]) & (each <= scan.hi)
        old = (rows != 0) & inside
        if whole.all():
            put = np.full(len(at), scan.hi + 1)
        else:
            zeros = np.cumsum(inside & ~old, 1)
            beyond = zeros > run[:, None]
            put = np.where(whole | ~beyond[:, -1], scan.hi + 1, beyond.argmax(1))
            wrong |= ~whole & (size == 1) & (put > scan.hi)
            old &= each < put[:, None]
        i, j = np.nonzero(old)
        counts = old.sum(1)
        position = at[i] + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        on = single[np.minimum(position, len(single) - 1)].astype(bool)
        cell = seq[block][i[on]], j[on]
        coef[cell] += np.where(coef[cell] > 0, one, -one).astype(coef.dtype)
        at += counts
        wrong |= at > bits.end[who]
        new = np.flatnonzero(~whole & (size == 1) & (put <= scan.hi) & ~wrong)
        coef[seq[block[new]], put[new]] = np.where(value[new] == 1, one, -one)
        bad[who[wrong]] = True
        k = put + 1
        over = (k > scan.hi) | wrong
        block += over
        k[over] = scan.lo
        left -= whole
        block[wrong] = stop[wrong]
        live = block < stop
        if not live.all():
            at, block, k, who, stop, left = (x[live] for x in (at, block, k, who, stop, left))


def _decode_dc(coef: np.ndarray, seq: np.ndarray, part: np.ndarray, lane: np.ndarray, stop: np.ndarray, bits: _Bits, scan: Scan, bad: np.ndarray) -> None:
    if scan.high:
        length = stop - lane
        which = np.repeat(np.arange(len(lane)), length)
        place = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
        bad[length > bits.end - bits.start] = True
        at = np.minimum(bits.start[which] + place, len(bits.data) * 8 - 1)
        on = bits.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        coef[seq[np.repeat(lane, length) + place], 0] |= (on.astype(coef.dtype)) << scan.low
        return
    table = np.concatenate([_lookup(t[0]) for t in scan.tables])
    at, block, who = bits.start.copy(), lane.copy(), np.arange(len(lane))
    before = np.zeros((len(lane), len(scan.tables)), np.int64)
    while len(at):
        c = part[block]
        window = bits.window(at)
        found = table[(window >> _U(48)).astype(np.int64) + (c << 16)]
        length, size = (found & 31).astype(np.int64), (found >> 5).astype(np.int64)
        wrong = (length == 0) | (size > 16)
        size[wrong] = 0
        at += length + size
        wrong |= at > bits.end[who]
        bad[who[wrong]] = True
        before[who, c] += np.where(size > 0, _extended(_after(window, length, size), size), 0)
        coef[seq[block], 0] = before[who, c] << scan.low
        block += 1
        block[wrong] = stop[wrong]
        live = block < stop
        if not live.all():
            at, block, who, stop = (x[live] for x in (at, block, who, stop))


@lru_cache(4096)
def _order(sampling: tuple, geometry: tuple, components: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a scan in its order, from the image's first block on; the place in the
    scan of each block's component; blocks of a coded unit."""
    starts = np.cumsum([0] + [g[0] * g[1] for g in geometry])
    if len(components) == 1:
        c = components[0]
        _, columns, own_rows, own_columns = geometry[c]
        ids = starts[c] + (np.arange(own_rows)[:, None] * columns + np.arange(own_columns)).ravel()
        return ids, np.zeros(len(ids), np.int64), 1
    ids = [starts[c] + _units(*sampling[c], *geometry[c][:2]) for c in components]
    part = [np.full(x.shape, k) for k, x in enumerate(ids)]
    return np.concatenate(ids, 1).ravel(), np.concatenate(part, 1).ravel(), sum(x.shape[1] for x in ids)


def _units(h: int, v: int, rows: int, columns: int) -> np.ndarray:
    """A component's blocks by coded unit: row by row within a unit."""
    r, q = np.divmod(np.arange(rows // v * (columns // h)), columns // h)
    a, b = np.divmod(np.arange(h * v), h)
    return (v * r[:, None] + a) * columns + h * q[:, None] + b


def decode_coefficients(images: list[Image]) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Coefficients (block, zigzag place) of all images, where each component's blocks begin,
    and which images hold broken data."""
    geometry = [_geometry(x) for x in images]
    starts, total = [], 0
    for g in geometry:
        starts.append([])
        for rows, columns, _, _ in g:
            starts[-1].append(total)
            total += rows * columns
    coef = np.zeros((total, 64), np.int32)
    broken = np.zeros(len(images), bool)
    for nth in range(max((len(x.scans) for x in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, x in enumerate(images):
            if nth < len(x.scans):
                s = x.scans[nth]
                groups.setdefault((tuple(s.components), tuple(s.tables), s.lo, s.hi, s.high, s.low, tuple(x.sampling)), []).append(i)
        for members in groups.values():
            scan = images[members[0]].scans[nth]
            patterns = [_order(tuple(images[i].sampling), tuple(geometry[i]), tuple(scan.components)) for i in members]
            sizes = np.array([len(x[0]) for x in patterns])
            base = np.array([starts[i][0] for i in members])
            seq = np.concatenate([x[0] for x in patterns]) + np.repeat(base, sizes)
            part = np.concatenate([x[1] for x in patterns])
            step = np.array([images[i].scans[nth].restart * x[2] or len(x[0]) for i, x in zip(members, patterns, strict=True)])
            wanted = -(-sizes // step)
            bits = _Bits([images[i].scans[nth].data for i in members])
            good = bits.count == wanted  # others have lost or surplus restart markers and are left out
            if not good.all():
                for k in np.flatnonzero(~good).tolist():
                    broken[members[k]] = True
                    images[members[k]].scans = images[members[k]].scans[:nth]
                if not good.any():
                    continue
                bits = _Bits([images[i].scans[nth].data for i, ok in zip(members, good, strict=True) if ok])
            lanes = np.where(good, wanted, 0)
            which = np.repeat(np.arange(len(members)), lanes)
            begin = (np.cumsum(sizes) - sizes)[which]
            first = begin + (np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * step[which]
            stop = np.minimum(first + step[which], begin + sizes[which])
            bad = np.zeros(len(first), bool)
            seq = np.append(seq, 0)
            if scan.lo == 0:
                _decode_dc(coef, seq, np.append(part, 0), first, stop, bits, scan, bad)
            else:
                (_decode_refine_ac if scan.high else _decode_first_ac)(coef, seq, first, stop, bits, scan, bad)
            broken[np.array(members)[which[bad]]] = True
    return coef, starts, broken


#: Binary digits of the fixed-point transform and colour conversion.
SHIFT = 14


@lru_cache(1)
def _basis() -> np.ndarray:
    """Pixels of each zigzag coefficient in fixed point; whole numbers, so that sums are
    exact in doubles and equal images give equal pixels in any batch."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    both = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << SHIFT))


def tensors(images: list[Image], coef: np.ndarray, starts: list[list[int]]) -> list[np.ndarray]:
    """Full-resolution RGB of every image: (height, width, 3), unsigned bytes."""
    out: list = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        groups.setdefault((tuple(x.sampling), b"".join(q.tobytes() for q in x.quant)), []).append(i)
    for (sampling, _), members in groups.items():
        hm, vm = (max(s[i] for s in sampling) for i in (0, 1))
        ids = [np.concatenate([starts[i][c] + _units(h, v, *_geometry(images[i])[c][:2]) for i in members]) for c, (h, v) in enumerate(sampling)]
        counts = [g[0] * g[1] // (sampling[0][0] * sampling[0][1]) for g in (_geometry(images[i])[0] for i in members)]
        n_units = len(ids[0])
        rgb = np.empty((n_units, 8 * vm, 8 * hm, 3), np.uint8)
        for lo in range(0, n_units, 256):  # few enough to stay in the processor's cache
            planes = []
            for c, (h, v) in enumerate(sampling):
                blocks = coef[ids[c][lo : lo + 256].ravel()] * images[members[0]].quant[c]
                pixels = blocks.astype(np.float64) @ _basis()
                pixels += (128 << SHIFT) + (1 << SHIFT - 1)
                pixels *= 2.0**-SHIFT
                np.clip(pixels, 0, 255.5, out=pixels)
                pixels = pixels.astype(np.int32).reshape(-1, v, h, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 8 * v, 8 * h)
                planes.append(pixels if (h, v) == (hm, vm) else pixels.repeat(vm // v, 1).repeat(hm // h, 2))
            own = rgb[lo : lo + 256]
            if len(planes) == 1:
                own[...] = planes[0][..., None]
                continue
            y, cb, cr = (planes[0] << SHIFT) + (1 << SHIFT - 1), planes[1] - 128, planes[2] - 128
            for channel, (b, r) in enumerate(((0, 1.402), (-0.344136, -0.714136), (1.772, 0))):
                value = y
                for weight, plane in ((b, cb), (r, cr)):
                    if weight:
                        value = value + round(weight * (1 << SHIFT)) * plane
                value = value >> SHIFT
                np.clip(value, 0, 255, out=value)
                own[..., channel] = value
        at = 0
        for i, n in zip(members, counts, strict=True):
            x = images[i]
            columns = -(-x.width // (8 * hm))
            tile = rgb[at : at + n].reshape(-1, columns, 8 * vm, 8 * hm, 3).transpose(0, 2, 1, 3, 4).reshape(-1, columns * 8 * hm, 3)
            out[i] = tile[: x.height, : x.width]
            at += n
    return out


def decode(files: list[bytes]) -> list[list[np.ndarray] | None]:
    """RGB tensors of all frames of progressive files, in their order; None for what is not
    a whole, valid file. What follows the last frame without beginning another is not read."""
    frames: list[Image] = []
    own: list[range | None] = []
    for raw in files:
        first, at = len(frames), 0
        try:
            while at == 0 or raw[at : at + 2] == b"\xff\xd8":
                frames.append(parse(raw, at))
                at = frames[-1].end
            own.append(range(first, len(frames)))
        except (MediaError, IndexError, KeyError, ValueError, struct.error):
            del frames[first:]
            own.append(None)
    coef, starts, broken = decode_coefficients(frames)
    got = tensors(frames, coef, starts)
    return [None if r is None or broken[r.start : r.stop].any() else got[r.start : r.stop] for r in own]


# ---------------------------------------------------------------- operators


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def store(texts: list[bytes]) -> list[bytes]:
    """The stored form of each text: its frames one after the other. A frame's comment has
    the text's bytes and the frame's payload bytes."""
    frames, notes, of = [], [], []
    for k, t in enumerate(texts):
        p = padded(t)
        for lo in range(0, len(p), FRAME):
            frames.append(p[lo : lo + FRAME])
            notes.append(struct.pack(">QI", len(t), len(frames[-1])))
            of.append(k)
    files: list[list[bytes]] = [[] for _ in texts]
    lo = 0
    while lo < len(frames):
        hi, held = lo, 0
        while hi < len(frames) and (held == 0 or held + len(frames[hi]) <= AT_ONCE):
            held += len(frames[hi])
            hi += 1
        for k, f in zip(of[lo:hi], encode_payloads(frames[lo:hi], notes[lo:hi]), strict=True):
            files[k].append(f)
        lo = hi
    return [b"".join(f) for f in files]


@dataclass
class Stored:
    """What is read back from a stored text."""

    n_bytes: int
    payload: bytes
    tensors: list[np.ndarray]


def read_back(media: list[bytes]) -> list[Stored]:
    """Payloads and RGB tensors of stored texts, from their bytes alone."""
    images, of = [], []
    for k, raw in enumerate(media):
        at = 0
        while at < len(raw):
            images.append(parse(raw, at))
            of.append(k)
            at = images[-1].end
    out = [Stored(0, b"", []) for _ in media]
    sizes = [struct.unpack(">QI", x.comment) for x in images]
    lo = 0
    while lo < len(images):
        hi, held = lo, 0
        while hi < len(images) and (held == 0 or held + sizes[hi][1] <= AT_ONCE):
            held += sizes[hi][1]
            hi += 1
        coef, starts, broken = decode_coefficients(images[lo:hi])
        if broken.any():
            raise MediaError("a stored frame is broken")
        for x, s, size, k, rgb in zip(images[lo:hi], starts, sizes[lo:hi], of[lo:hi], tensors(images[lo:hi], coef, starts), strict=True):
            n = size[1] // 64
            out[k].n_bytes = size[0]
            out[k].payload += (coef[s[0] : s[0] + n] + OFFSET).astype(np.uint8).tobytes()
            out[k].tensors.append(rgb)
        lo = hi
    return out


def feature(frames: list[np.ndarray]) -> str:
    """Size of the pictures, and mean and deviation of each channel over them."""
    n, sums, squares = 0, np.zeros(3), np.zeros(3)
    for x in frames:  # sums of whole numbers in doubles: exact in any order
        flat = x.reshape(-1, 3).astype(np.float64)
        n += len(flat)
        sums += np.ones(len(flat)) @ flat
        squares += np.diag(flat.T @ flat)
    mean = sums / n
    dev = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return f"{frames[0].shape[1]}x{frames[0].shape[0]}x{len(frames)}:" + ",".join(f"{m:.4f}/{d:.4f}" for m, d in zip(mean, dev, strict=True))


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, MEDIA): every text stored as progressive frames and read back. Null and empty
    texts are 64 zero bytes; equal texts give equal values; repeated rows and null ids keep
    their rows; other columns are not read."""
    schema = f"{id_col} long, {MEDIA}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            texts = utf8(batch)
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (held == 0 or held + len(texts[hi]) <= AT_ONCE):
                    held += len(texts[hi]) + 64
                    hi += 1
                media = store(texts[lo:hi])
                rows = []
                for raw, got in zip(media, read_back(media), strict=True):
                    p = got.payload
                    rows.append((got.n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(got.tensors)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)
                lo = hi

    return bounded(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).alias("text"))).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, media): the stored form of every text. Null and empty texts are 64 zero bytes;
    repeated rows and null ids keep their rows; other columns are not read."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(store(utf8(part)), pa.binary())], names=[id_col, "media"])

    return bounded(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).alias("text"))).mapInArrow(run, f"{id_col} long, media binary")


def decode_media(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """(id, frames): the full-resolution RGB tensors of every progressive file, all its frames
    in order, as rows of pixels of three bytes with their height and width. Null, empty and
    invalid files have null; repeated rows and null ids keep their rows."""
    schema = f"{id_col} long, frames array<struct<height:int,width:int,rgb:binary>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                got = decode([x or b"" for x in part.column(1).to_pylist()])
                frames = [None if x is None else [{"height": f.shape[0], "width": f.shape[1], "rgb": f.tobytes()} for f in x] for x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(frames, arrow.field(1).type)], schema=arrow)

    return bounded(df.select(F.col(id_col).cast("long").alias(id_col), F.col(media))).mapInArrow(run, schema)
