import random
import struct

import numpy as np
import pytest

from facteng.llm import jpeg as J
from facteng.llm import media as M


class Writer:
    """A plain progressive encoder for tests: canonical codes of eight bits for all symbols, one component or more."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 9)  # the code of symbol s is s in nine bits

    def value(self, v, size):
        if size:
            self.put(v if v > 0 else v + (1 << size) - 1, size)

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(sum(b << (7 - k) for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def table(kind):
    # 256 symbols with nine-bit codes 0..255
    return J._segment(0xC4, bytes([kind << 4] + [0] * 8 + [255] + [0] * 7) + bytes(range(255)))


def shift(v, al):
    return (abs(v) >> al) * (1 if v > 0 else -1)


def first_ac(w, block, ss, se, al, runs):
    """Zero runs, and end-of-band runs over several blocks."""
    z = [shift(int(v), al) for v in block[ss : se + 1]]
    last = max((i for i, v in enumerate(z) if v), default=-1)
    if last < 0:
        runs.append(1)
        return
    flush(w, runs)
    run = 0
    for v in z[: last + 1]:
        if not v:
            run += 1
            continue
        while run > 15:
            w.symbol(0xF0)
            run -= 16
        size = abs(v).bit_length()
        w.symbol(run << 4 | size)
        w.value(v, size)
        run = 0
    if last < len(z) - 1:
        runs.append(1)


def flush(w, runs, tail=()):
    n = len(runs)
    if n:
        r = n.bit_length() - 1
        w.symbol(r << 4)
        w.put(n - (1 << r), r)
        for t in tail:
            w.bits += t
    runs.clear()


def refine_ac(w, block, ss, se, al):
    """One block at a time, ends of band never joined."""
    z = [abs(int(v)) >> al for v in block[ss : se + 1]]
    last_new = max((i for i, v in enumerate(z) if v == 1), default=-1)
    run, pending = 0, []
    for i, v in enumerate(z):
        if i > last_new:
            break
        if v == 0:
            run += 1
            if run == 16 and any(x == 1 for x in z[i + 1 : last_new + 1]):
                w.symbol(0xF0)
                w.bits += pending
                run, pending = 0, []
        elif v > 1:
            pending.append(v & 1)
        else:
            w.symbol(run << 4 | 1)
            w.put(1 if block[ss + i] > 0 else 0, 1)
            w.bits += pending
            run, pending = 0, []
    rest = [v & 1 for i, v in enumerate(z) if i > last_new and v > 1]
    if last_new < len(z) - 1:
        w.symbol(0)
        w.bits += rest


def encode(components, width, height):
    """components: (h, v, coefficients (rows, columns, 64)); DC interleaved in two approximations, AC in two bands."""
    out = [b"\xff\xd8", J._segment(0xDB, bytes([0] + [3] * 64)), J._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([k, h << 4 | v, 0]) for k, (h, v, _) in enumerate(components, 1))), table(0), table(1)]
    hm, vm = max(c[0] for c in components), max(c[1] for c in components)
    order = []
    for y in range(-(-height // (8 * vm))):
        for x in range(-(-width // (8 * hm))):
            for k, (h, v, _) in enumerate(components):
                order += [(k, y * v + b, x * h + a) for b in range(v) for a in range(h)]
    ids = b"".join(bytes([k, 0]) for k in range(1, len(components) + 1))
    w, last = Writer(), [0] * len(components)
    for k, y, x in order:
        v = int(components[k][2][y, x, 0]) >> 1
        d = v - last[k]
        last[k] = v
        size = abs(d).bit_length()
        w.symbol(size)
        w.value(d, size)
    out += [J._segment(0xDA, bytes([len(components)]) + ids + bytes([0, 0, 0x01])), w.bytes()]
    for k, (h, v, z) in enumerate(components, 1):
        down, across = -(-height * v // (8 * vm)), -(-width * h // (8 * hm))
        for ss, se in ((1, 5), (6, 63)):
            w, runs = Writer(), []
            for y in range(down):
                for x in range(across):
                    first_ac(w, z[y, x], ss, se, 1, runs)
            flush(w, runs)
            out += [J._segment(0xDA, bytes([1, k, 0, ss, se, 0x01])), w.bytes()]
            w = Writer()
            for y in range(down):
                for x in range(across):
                    refine_ac(w, z[y, x], ss, se, 0)
            out += [J._segment(0xDA, bytes([1, k, 0, ss, se, 0x10])), w.bytes()]
    w = Writer()
    for k, y, x in order:
        w.put(int(components[k][2][y, x, 0]) & 1, 1)
    out += [J._segment(0xDA, bytes([len(components)]) + ids + bytes([0, 0, 0x10])), w.bytes()]
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("seed,width,height,subsampled", [(1, 16, 16, True), (2, 33, 21, True), (3, 24, 40, False), (4, 8, 8, None)])
def test_general_progressive_streams(seed, width, height, subsampled):
    r = np.random.default_rng(seed)
    shape = [(2, 2), (1, 1), (1, 1)] if subsampled else [(1, 1)] * (1 if subsampled is None else 3)
    hm, vm = max(h for h, _ in shape), max(v for _, v in shape)
    comps = []
    for h, v in shape:
        rows, cols = -(-height // (8 * vm)) * v, -(-width // (8 * hm)) * h
        z = r.integers(-40, 41, (rows, cols, 64)) * (r.random((rows, cols, 64)) < 0.15)
        z[..., 0] = r.integers(-200, 200, (rows, cols))
        z[0, 0, 1:] = 0
        comps.append((h, v, z))
    image = J.read_coefficients(encode(comps, width, height))
    for c, (_, _, z) in zip(image.components, comps, strict=True):
        assert (c.coefficients[: c.down, : c.across] == z[: c.down, : c.across]).all()
    rgb = J.to_rgb(image)
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    plain = np.zeros(64)
    plain[J.ZIGZAG] = comps[0][2][0, 0] * 3.0
    u = lambda k: np.sqrt(1 / 8) if k == 0 else 0.5
    want = [[sum(u(a) * u(b) * plain[8 * a + b] * np.cos((2 * y + 1) * a * np.pi / 16) * np.cos((2 * x + 1) * b * np.pi / 16) for a in range(8) for b in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose(J.samples(image.components[0], image.quant[0])[:8, :8], want, atol=0.01)
    if subsampled:  # chroma covers two by two samples
        cb = J.samples(image.components[1], image.quant[0])
        cr = J.samples(image.components[2], image.quant[0])
        y = J.samples(image.components[0], image.quant[0]) + 128
        assert rgb[3, 5, 2] == np.clip(np.rint(y[3, 5] + 1.772 * cb[1, 2]), 0, 255)
        assert rgb[3, 5, 0] == np.clip(np.rint(y[3, 5] + 1.402 * cr[1, 2]), 0, 255)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 24, 25, 100])
def test_payload_round_trip_by_both_readers(monkeypatch, n):
    payload = random.Random(n).randbytes(64 * n)
    data = J.encode_payload(payload)
    image = J.read_coefficients(data)
    assert J.decode_payload(image) == payload
    monkeypatch.setattr(J, "_fast_scan", lambda *a: False)
    for c, d in zip(image.components, J.read_coefficients(data).components, strict=True):
        assert (c.coefficients == d.coefficients).all()


def test_payloads_of_extreme_bytes():
    for b in (b"\0", b"\xff", b"\x7f\x80"):
        p = (b * 64)[:64] * 9
        assert J.decode_payload(J.read_coefficients(J.encode_payload(p))) == p
    with pytest.raises(ValueError):
        J.encode_payload(b"")


def test_media_columns(spark, docs, rows, none):
    import hashlib
    import zlib

    got = {(r.doc_id, r.payload_sha256): r for r in M.digests(M.encode(docs)).collect()}
    for r in rows:
        text = (r[1] or "").encode()
        p = text + b"\0" * (-len(text) % 64 or 64 * (not text))
        d = got[r[0], hashlib.sha256(p).hexdigest()]
        assert (d.n_bytes, d.payload_bytes, d.tail_crc32) == (len(text), len(p), zlib.crc32(p[-64:]))
    assert M.digests(M.encode(none)).count() == 0
    tensor = M.decode(M.encode(docs.where("doc_id = 8"))).first()
    assert len(tensor.rgb) == tensor.height * tensor.width * 3 == 16 * 16 * 3
