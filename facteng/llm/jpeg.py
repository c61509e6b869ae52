"""Progressive JPEG in numpy: coefficient arrays accumulated over scans, and a lossless payload format on top.

The decoder reads baseline and progressive Huffman streams (spectral selection, successive approximation, end-of-band
runs, restart intervals), accumulates every scan into the coefficient array of its component, dequantises, applies
the inverse transform as two matrix products, upsamples chroma and converts to RGB at full resolution.

Scans whose Huffman table has a single symbol have codes of one length, so all their coefficients lie at
fixed bit places and are read at once; any other scan is read symbol by symbol. The payload format writes such scans
only. The upper seven bits of a payload byte become an AC coefficient of seven bits, sign and all, which with its one-bit code
fill a byte of the first scan; a second scan refines it by the lowest bit. DC coefficients are differences of
magnitude 256 and more, whose signs keep their sum small.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The zigzag order of coefficients, by rule.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_X, _U = np.meshgrid(np.arange(8), np.arange(8))
#: Rows are the orthonormal cosine basis.
BASIS = (np.cos((2 * _X + 1) * _U * np.pi / 16) * np.where(_U == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)
TAG = b"payload\0"
#: Magnitude of the DC difference of a zero byte.
OFFSET = 256


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks that carry samples
    down: int = 0
    wide: int = 0  # blocks with the filling of whole units
    high: int = 0
    coefficients: np.ndarray | None = None  # (high, wide, 64) in zigzag order


@dataclass
class Image:
    width: int = 0
    height: int = 0
    progressive: bool = True
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class Huffman:
    """Canonical codes; look-up by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.single = (next(i for i, c in enumerate(counts, 1) if c), symbols[0]) if sum(counts) == 1 else None


class Bits:
    """Bits of an entropy-coded piece, stuffing removed."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        if self.at + n > len(self.bits):
            raise ValueError("the scan ends early")
        self.at += n
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            got = table.codes.get((length, code))
            if got is not None:
                return got
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        if not size:
            return 0
        got = self.take(size)
        return got if got >> (size - 1) else got - (1 << size) + 1


def _numbers(bits: np.ndarray, n: int, length: int) -> np.ndarray:
    """n numbers of length bits each."""
    if len(bits) < n * length:
        raise ValueError("the scan ends early")
    wide = np.zeros((n, 16), np.uint8)
    wide[:, 16 - length :] = bits[: n * length].reshape(n, length)
    return np.packbits(wide, axis=1).view(">u2").ravel().astype(np.int32)


def _signed(raw: np.ndarray, size: int) -> np.ndarray:
    return np.where(raw >> (size - 1), raw, raw - (1 << size) + 1)


def _fast_scan(c: Component, tables: tuple, ss: int, se: int, ah: int, al: int, data: bytes) -> bool:
    """Reads a scan of one component whose codes all have one length; says whether it could."""
    coef, n = c.coefficients[: c.down, : c.across], c.down * c.across
    band = se - ss + 1
    if ss == 0 and se == 0 and ah:
        got = Bits(data).bits[:n]
        coef[..., 0] |= got.reshape(c.down, c.across).astype(np.int32) << al
        return True
    table = tables[0 if ss == 0 else 1]
    if table is None or table.single is None:
        return False
    length, symbol = table.single
    if ss == 0 and 0 < symbol <= 11:
        raw = _numbers(Bits(data).bits, n, length + symbol) & ((1 << symbol) - 1)
        coef[..., 0] = (np.cumsum(_signed(raw, symbol)) << al).reshape(c.down, c.across)
        return True
    if ss and not ah and 0 < symbol <= 10 and length + symbol <= 16:  # a run of no zeros and one size
        raw = _numbers(Bits(data).bits, n * band, length + symbol) & ((1 << symbol) - 1)
        coef[..., ss : se + 1] = (_signed(raw, symbol) << al).reshape(c.down, c.across, band)
        return True
    if ss and ah and symbol == 0 and (coef[..., ss : se + 1] != 0).all():  # an end of band, then a correction of each
        bits = Bits(data).bits
        if len(bits) < n * (length + band):
            raise ValueError("the scan ends early")
        more = bits[: n * (length + band)].reshape(n, length + band)[:, length:].reshape(c.down, c.across, band).astype(np.int32) << al
        part = coef[..., ss : se + 1]
        coef[..., ss : se + 1] = np.where(part > 0, part + more, part - more)
        return True
    return False


def _slow_scan(parts: list[tuple[Component, tuple]], image: Image, ss: int, se: int, ah: int, al: int, pieces: list[bytes], restart: int) -> None:
    """Reads any scan symbol by symbol."""
    if len(parts) == 1:
        c = parts[0][0]
        units = [[(0, y, x)] for y in range(c.down) for x in range(c.across)]
    else:
        first = parts[0][0]
        units = []
        for y in range(first.high // first.v):
            for x in range(first.wide // first.h):
                units.append([(k, y * c.v + dy, x * c.h + dx) for k, (c, _) in enumerate(parts) for dy in range(c.v) for dx in range(c.h)])
    step = restart or len(units)
    for at in range(0, len(units), max(step, 1)):
        bits, last, run = Bits(pieces[at // step]), [0] * len(parts), 0
        for unit in units[at : at + step]:
            for k, y, x in unit:
                c, (dc, ac) = parts[k]
                z = c.coefficients[y, x]
                if ss == 0:
                    if ah:
                        z[0] |= bits.take(1) << al
                    else:
                        last[k] += bits.value(bits.symbol(dc))
                        z[0] = last[k] << al
                    if image.progressive:
                        continue
                i = max(ss, 1)
                if not ah:
                    if run:
                        run -= 1
                        continue
                    while i <= se:
                        r, s = divmod(bits.symbol(ac), 16)
                        if s == 0 and r < 15:
                            run = (1 << r) - 1 + (bits.take(r) if r else 0) if image.progressive else 0
                            break
                        i += r
                        if s:
                            z[i] = bits.value(s) << al
                        i += 1
                    continue
                one = 1 << al
                if not run:
                    while i <= se:
                        r, s = divmod(bits.symbol(ac), 16)
                        new = 0
                        if s:
                            new = one if bits.take(1) else -one
                        elif r < 15:
                            run = (1 << r) + (bits.take(r) if r else 0)
                            break
                        while i <= se:
                            if z[i]:
                                if bits.take(1):
                                    z[i] += one if z[i] > 0 else -one
                            elif r:
                                r -= 1
                            else:
                                if new:
                                    z[i] = new
                                i += 1
                                break
                            i += 1
                if run:
                    for j in range(i, se + 1):
                        if z[j] and bits.take(1):
                            z[j] += one if z[j] > 0 else -one
                    run -= 1


def read_coefficients(data: bytes) -> Image:
    """Accumulates all scans of a JPEG stream into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    image, tables, restart, at = Image(), {}, 0, 2
    while True:
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC2):
            image.progressive = marker == 0xC2
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            image.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            hmax, vmax = (max(getattr(c, k) for c in image.components) for k in "hv")
            for c in image.components:
                c.across, c.down = -(-image.width * c.h // (8 * hmax)), -(-image.height * c.v // (8 * vmax))
                c.wide, c.high = -(-image.width // (8 * hmax)) * c.h, -(-image.height // (8 * vmax)) * c.v
                c.coefficients = np.zeros((c.high, c.wide, 64), np.int32)
        elif marker == 0xDA:
            n = body[0]
            byid = {c.ident: c for c in image.components}
            parts = [(byid[body[1 + 2 * k]], (tables.get((0, body[2 + 2 * k] >> 4)), tables.get((1, body[2 + 2 * k] & 15)))) for k in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            pieces, start = [], at
            while True:
                end = data.index(b"\xff", at)
                if data[end + 1] == 0:
                    at = end + 2
                elif 0xD0 <= data[end + 1] <= 0xD7:
                    pieces.append(data[start:end])
                    start = at = end + 2
                else:
                    pieces.append(data[start:end])
                    at = end
                    break
            if restart or n > 1 or not image.progressive or not _fast_scan(parts[0][0], parts[0][1], ss, se, approx >> 4, approx & 15, pieces[0]):
                _slow_scan(parts, image, ss, se, approx >> 4, approx & 15, pieces, restart)


def samples(c: Component, quant: np.ndarray) -> np.ndarray:
    """Inverse transform of a component: (8 * high, 8 * wide) float32 around zero."""
    plain = np.zeros(c.coefficients.shape, np.float32)
    plain[..., ZIGZAG] = c.coefficients * quant
    blocks = BASIS.T @ plain.reshape(-1, 8, 8) @ BASIS
    return blocks.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)


def to_rgb(image: Image) -> np.ndarray:
    """(height, width, 3) uint8 at full resolution; chroma is upsampled by repetition."""
    hmax, vmax = (max(getattr(c, k) for c in image.components) for k in "hv")
    planes = []
    for c in image.components:
        p = samples(c, image.quant[c.table])
        if hmax != c.h or vmax != c.v:
            p = p.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)
        planes.append(p[: image.height, : image.width])
    y = planes[0] + 128.0
    if len(planes) == 1:
        rgb = [y, y, y]
    else:
        cb, cr = planes[1], planes[2]
        rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    out = np.empty((*y.shape, 3), np.uint8)
    for k, plane in enumerate(rgb):
        np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
        out[..., k] = plane
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int) -> bytes:
    """A Huffman table whose one symbol has the one-bit code 0."""
    return _segment(0xC4, bytes([kind << 4, 1] + [0] * 15 + [symbol]))


def _pack(values: np.ndarray, length: int, lead: int) -> bytes:
    """Each value as lead zero bits (the code) and length - lead bits; the end is padded by ones, FF is stuffed."""
    bits = np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - length :].ravel()
    return _stuffed(bits)


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate((bits, np.ones(pad, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


#: Fixed parts of a payload stream: quantisation by one, chroma of half size, and the tables of the scans.
_HEAD = _segment(0xDB, bytes([0] + [1] * 64))
_DC, _FIRST, _REFINE = _table(0, 9), _table(1, 7), _table(1, 0)


def _dc_signs(dc: np.ndarray) -> np.ndarray:
    """Differences of the given magnitudes whose running sum stays within one magnitude of zero."""
    out, level = [], 0
    for m in dc.tolist():
        d = -m if level > 0 else m
        level += d
        out.append(d)
    return np.array(out, np.int32)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG (4:2:0) whose coefficients hold payload, a positive multiple of 64 bytes; a block of 64
    coefficients holds 64 bytes. Blocks fill the luma component first, then both chroma components."""
    n = len(payload) // 64
    if n * 64 != len(payload) or not n:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-n // 6)
    across = min(int(np.ceil(np.sqrt(units))), 4095)
    down = -(-units // across)
    if down > 4095:
        raise ValueError("a payload of this size exceeds one image")
    blocks = np.zeros((6 * across * down, 64), np.int32)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    luma = 4 * across * down
    parts = (blocks[:luma], blocks[luma : luma + across * down], blocks[luma + across * down :])
    out = [b"\xff\xd8", _segment(0xFE, TAG + struct.pack(">Q", n)), _HEAD]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_DC)
    for k, part in enumerate(parts, 1):
        d = _dc_signs(part[:, 0] + OFFSET)
        out += [_segment(0xDA, bytes([1, k, 0, 0, 0, 0])), _pack(np.where(d > 0, d, d + 511), 10, 1)]
    out.append(_FIRST)
    for k, part in enumerate(parts, 1):
        out += [_segment(0xDA, bytes([1, k, 0, 1, 63, 1])), _pack(part[:, 1:] >> 1, 8, 1)]
    out.append(_REFINE)
    for k, part in enumerate(parts, 1):
        bits = (part & 1).astype(np.uint8)
        bits[:, 0] = 0  # the code of the end of band, then 63 corrections
        out += [_segment(0xDA, bytes([1, k, 0, 1, 63, 0x10])), _stuffed(bits.ravel())]
    return b"".join(out) + b"\xff\xd9"


def decode_payload(image: Image) -> bytes:
    """The payload held by the coefficients of an image that encode_payload wrote."""
    if not image.comment.startswith(TAG):
        raise ValueError("the image holds no payload")
    n = struct.unpack(">Q", image.comment[len(TAG) :])[0]
    parts = []
    for c in image.components:
        z = c.coefficients.reshape(-1, 64)
        size = np.abs(z)
        upper = np.where(z > 0, size >> 1, 127 - (size >> 1))
        out = upper << 1 | size & 1
        out[:, 0] = np.abs(np.diff(z[:, 0], prepend=0)) - OFFSET
        parts.append(out)
    return np.concatenate(parts)[:n].astype(np.uint8).tobytes()
