import hashlib
import random
import zlib

import numpy as np

from rotagraph.llm import media


def bytes_of(kind, n, seed):
    r = random.Random(seed)
    return bytes(r.choice(kind) for _ in range(n))


def test_any_bytes_survive():
    tests = [b"", b"a", b"[" * 500, b"[" * 200 + b"\\" + b"[" * 300, bytes(range(256)) * 5]
    tests += [bytes_of(kind, n, n) for n in (1, 63, 64, 65, 384, 5000) for kind in (b"Z[\\", range(256), b"[" * 25 + b"Za")]
    tests.append(bytes_of(range(256), 700_000, 3))  # several frames
    for t, got in zip(tests, media.read_back(media.store(tests)), strict=True):
        assert got.n_bytes == len(t) and got.payload == media.padded(t)


def test_equal_texts_give_equal_values_in_any_batch():
    texts = [bytes_of(b"abc de.", 200 + i, i) for i in range(20)]
    together, alone = media.store(texts), [media.store([t])[0] for t in texts]
    assert together == alone
    for a, b in zip(media.read_back(together), alone, strict=True):
        assert np.array_equal(a.tensors[0], media.read_back([b])[0].tensors[0])


def test_transform_equals_floating_point():
    blocks = np.random.default_rng(0).integers(-90, 90, (6, 64))
    file = media.encode_payloads([(blocks + media.OFFSET).astype(np.uint8).tobytes()], [b""])[0]
    rgb = media.decode([file])[0][0].astype(int)
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x * np.pi / 16) / 2 * np.where(x == 0, np.sqrt(0.5), 1)
    plain = np.zeros((6, 8, 8))
    for k, z in enumerate(media.ZIGZAG):
        plain += blocks[:, k, None, None] * np.outer(c[:, z // 8], c[:, z % 8])
    plain = np.clip(np.rint(plain + 128), 0, 255)
    y = np.block([[plain[0], plain[1]], [plain[2], plain[3]]])
    cb, cr = (np.kron(p, np.ones((2, 2))) - 128 for p in plain[4:])
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    assert np.abs(rgb - np.clip(want, 0, 255)).max() <= 2


def test_broken_files_are_null():
    good = media.store([b"hello world " * 50])[0]
    cut = good[: len(good) // 2]
    assert media.decode([b"", b"\xff\xd8", cut, good])[:3] == [None, None, None]
    assert media.decode([good + cut, good + b"\x00rest"])[0] is None and len(media.decode([good + b"\x00rest"])[0]) == 1


def test_all_frames_are_decoded():
    text = bytes_of(range(256), 600_000, 9)
    stored = media.store([text, b"short"])
    got, want = media.decode(stored), media.read_back(stored)
    assert len(got[0]) == 3 and len(got[1]) == 1
    for frames, kept in zip(got, want, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(frames, kept.tensors, strict=True))


class Written:
    """Bits of one scan, by codes of equal length, with runs of blocks that end early."""

    def __init__(self, symbols, size):
        self.code, self.size, self.bits = {s: k for k, s in enumerate(symbols)}, size, []
        self.run, self.later = 0, []

    def put(self, value, size):
        self.bits += [value >> k & 1 for k in reversed(range(size))]

    def symbol(self, s, value=0, size=0):
        self.put(self.code[s], self.size)
        self.put(value, size)

    def flush(self):
        if self.run:
            k = self.run.bit_length() - 1
            self.symbol(k << 4, self.run - (1 << k), k)
            self.bits += self.later
        self.run, self.later = 0, []

    def bytes(self):
        self.flush()
        self.bits += [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def signed(v):
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


def plain_file(width, height, sampling, coefs, quant):
    """A progressive file without restart intervals, block by block as the standard tells:
    constant terms of all components together, the others by component, high bits first."""
    dc_symbols, ac_symbols = list(range(12)), [r << 4 | s for r in range(16) for s in range(11)]
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    part = lambda marker, body: b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8"
    for c, q in enumerate(quant):
        out += part(0xDB, bytes([c]) + bytes(q))
    out += part(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([c + 1, h << 4 | v, c]) for c, (h, v) in enumerate(sampling)))
    for kind, symbols, size in ((0x00, dc_symbols, 4), (0x10, ac_symbols, 8)):
        out += part(0xC4, bytes([kind]) + bytes(len(symbols) * (k == size) for k in range(1, 17)) + bytes(symbols))

    def scan(which, lo, hi, high, low, data):
        return part(0xDA, bytes([len(which)]) + b"".join(bytes([c + 1, 0]) for c in which) + bytes([lo, hi, high << 4 | low])) + data

    def together():
        for r in range(-(-height // (8 * vm))):
            for q in range(-(-width // (8 * hm))):
                for c, (h, v) in enumerate(sampling):
                    for a in range(v):
                        for b in range(h):
                            yield c, coefs[c][r * v + a, q * h + b]

    def alone(c):
        h, v = sampling[c]
        for r in range(-(-(-(-height * v // vm)) // 8)):
            for q in range(-(-(-(-width * h // hm)) // 8)):
                yield coefs[c][r, q].tolist()

    def first(c, lo, hi, low):
        w = Written(ac_symbols, 8)
        for block in alone(c):
            zeros = 0
            for k in range(lo, hi + 1):
                v = (abs(block[k]) >> low) * (1 if block[k] > 0 else -1)
                if v == 0:
                    zeros += 1
                    continue
                w.flush()
                while zeros > 15:
                    w.symbol(0xF0)
                    zeros -= 16
                value, n = signed(v)
                w.symbol(zeros << 4 | n, value, n)
                zeros = 0
            w.run += zeros > 0
        return scan([c], lo, hi, 0, low, w.bytes())

    def refined(c, lo, hi, low):
        w = Written(ac_symbols, 8)
        for block in alone(c):
            size = [abs(x) >> low for x in block]
            last = max((k for k in range(lo, hi + 1) if size[k] == 1), default=-1)
            zeros, known = 0, []
            for k in range(lo, hi + 1):
                if size[k] == 0:
                    zeros += 1
                    continue
                while zeros > 15 and k <= last:
                    w.flush()
                    w.symbol(0xF0)
                    w.bits += known
                    zeros, known = zeros - 16, []
                if size[k] > 1:
                    known.append(size[k] & 1)
                    continue
                w.flush()
                w.symbol(zeros << 4 | 1, int(block[k] > 0), 1)
                w.bits += known
                zeros, known = 0, []
            if zeros or known:
                w.run += 1
                w.later += known
        return scan([c], lo, hi, low + 1, low, w.bytes())

    every = range(len(sampling))
    w, before = Written(dc_symbols, 4), [0] * len(sampling)
    for c, block in together():
        v = int(block[0]) >> 1
        value, n = signed(v - before[c])
        w.symbol(n, value, n)
        before[c] = v
    out += scan(every, 0, 0, 0, 1, w.bytes())
    out += b"".join(first(c, 1, 5, 2) + first(c, 6, 63, 1) for c in every)
    out += b"".join(refined(c, 1, 5, 1) + refined(c, 6, 63, 0) for c in every)
    w = Written(dc_symbols, 4)
    for _, block in together():
        w.put(int(block[0]) & 1, 1)
    return out + scan(every, 0, 0, 1, 0, w.bytes()) + b"".join(refined(c, 1, 5, 0) for c in every) + b"\xff\xd9"


def plain_pixels(width, height, sampling, coefs, quant):
    x = np.arange(8)
    cos = np.cos((2 * x[:, None] + 1) * x * np.pi / 16) / 2 * np.where(x == 0, np.sqrt(0.5), 1)
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = []
    for (h, v), own, q in zip(sampling, coefs, quant, strict=True):
        square = np.zeros((*own.shape[:2], 8, 8))
        for k, z in enumerate(media.ZIGZAG):
            square[..., z // 8, z % 8] = own[..., k] * q[k]
        pixels = np.clip(np.rint(cos @ square @ cos.T + 128), 0, 255).transpose(0, 2, 1, 3).reshape(own.shape[0] * 8, -1)
        planes.append(pixels.repeat(vm // v, 0).repeat(hm // h, 1)[:height, :width])
    if len(planes) == 1:
        return np.stack(planes * 3, -1)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)


def test_files_of_a_plain_writer():
    r = np.random.default_rng(7)
    files, want = [], []
    shapes = [(1, 1, [(1, 1)]), (37, 21, [(1, 1)]), (37, 21, [(1, 1)] * 3), (50, 33, [(2, 2), (1, 1), (1, 1)]), (41, 70, [(2, 1), (1, 1), (1, 1)]), (9, 95, [(1, 2), (1, 1), (1, 1)]), (64, 64, [(2, 2), (2, 1), (1, 2)])]
    for width, height, sampling in shapes:
        hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
        coefs = []
        for h, v in sampling:
            rows, columns = -(-height // (8 * vm)) * v, -(-width // (8 * hm)) * h
            block = r.integers(-9, 10, (rows, columns, 64)) * (r.random((rows, columns, 64)) < 0.15) * (r.random((rows, columns, 1)) < 0.6)
            block[..., 0] = r.integers(-150, 150, (rows, columns))
            own = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
            block[own[0] :, :, 1:] = block[:, own[1] :, 1:] = 0  # blocks beyond the picture have a constant term only
            coefs.append(block)
        quant = [[int(x) for x in r.integers(1, 6, 64)] for _ in sampling]
        files.append(plain_file(width, height, sampling, coefs, quant))
        want.append((coefs, plain_pixels(width, height, sampling, coefs, quant)))
    images = [media.parse(f, 0) for f in files]
    coef, starts, broken = media.decode_coefficients(images)
    assert not broken.any()
    for (coefs, _), start in zip(want, starts, strict=True):
        for own, at in zip(coefs, start, strict=True):
            assert np.array_equal(coef[at : at + own.shape[0] * own.shape[1]], own.reshape(-1, 64))
    for (_, pixels), got in zip(want, media.decode(files), strict=True):
        assert got[0].shape == pixels.shape and np.abs(got[0].astype(float) - pixels).max() <= 3


def test_operator(spark, odd, none):
    rows = media.stored_texts(odd).collect()
    assert len(rows) == odd.count()
    want = sorted(hashlib.sha256(media.padded((r.text or "").encode())).hexdigest() for r in odd.select("text").collect())
    assert sorted(r.payload_sha256 for r in rows) == want
    empty = next(r for r in rows if r.doc_id == 3)
    assert (empty.n_bytes, empty.payload_bytes, empty.tail_crc32) == (0, 64, zlib.crc32(bytes(64)))
    assert media.stored_texts(none).count() == 0
    decoded = media.decode_media(media.encode_texts(odd), "doc_id").collect()
    assert len(decoded) == len(rows) and all(len(f.rgb) == f.height * f.width * 3 for r in decoded for f in r.frames)
    assert max(len(r.frames) for r in decoded) == 4
    bad = odd.sparkSession.createDataFrame([(1, None), (1, b""), (None, b"\xff\xd8\xff")], "doc_id long, media binary")
    assert [r.frames for r in media.decode_media(bad, "doc_id").collect()] == [None] * 3
