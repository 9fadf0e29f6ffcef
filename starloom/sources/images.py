"""PNG and baseline JPEG encoders in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """8-bit PNG of (h, w), (h, w, 3) or (h, w, 4) pixels."""
    px = np.ascontiguousarray(pixels, np.uint8)
    h, w = px.shape[:2]
    kind = {2: 0, 3: {3: 2, 4: 6}.get(px.shape[-1])}[px.ndim]
    if kind is None:
        raise ValueError("3 or 4 channels are needed")
    rows = np.zeros((h, 1 + px.reshape(h, -1).shape[1]), np.uint8)
    rows[:, 1:] = px.reshape(h, -1)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """Pixels of a PNG that ``png`` wrote."""
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    at, body = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        body += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    c = {0: 1, 2: 3, 6: 4}[kind]
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)[:, 1:].reshape((h, w, c) if c > 1 else (h, w))


# The JPEG standard's example tables (Annex K), in natural order.
LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))


def _zigzag() -> list[int]:
    return [x for _, x in sorted(((r + c, r if (r + c) % 2 else c), 8 * r + c) for r in range(8) for c in range(8))]


def _quality(table: list[int], q: int) -> np.ndarray:
    s = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(table) * s + 50) // 100, 1, 255)


def _huffman(counts: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    code, k, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _flat_ac() -> tuple[list[int], list[int]]:
    """AC symbols (run, size) by a rule: 162 codes of 4 to 10 bits, short runs and sizes first."""
    symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    symbols.sort(key=lambda x: ((x >> 4) * 1.5 + (x & 15) * 1.2 if x not in (0x00,) else 0, x))
    counts, lengths = [0] * 16, [(4, 6), (5, 6), (6, 8), (7, 12), (8, 22), (9, 44)]
    for bits, n in lengths:
        counts[bits - 1] = n
    rest = len(symbols) - sum(counts)
    counts[9] = rest
    return counts, symbols


AC_COUNTS, AC_VALUES = _flat_ac()


def jpeg(pixels: np.ndarray, quality: int = 90) -> bytes:
    """Baseline 4:2:0 JPEG of (h, w, 3) or (h, w, 4) pixels; quality is clamped to 1..100, a fourth channel is left out."""
    px = np.asarray(pixels)
    if px.ndim != 3 or px.shape[2] not in (3, 4):
        raise ValueError("3 or 4 channels are needed")
    q, (h, w) = min(max(int(quality), 1), 100), px.shape[:2]
    rgb = np.pad(px[:, :, :3].astype(float), ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    half = lambda p: p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))
    cb, cr = half(0.564334 * (b - y)), half(0.713267 * (r - y))
    k = np.arange(8)
    basis = np.sqrt(np.where(k[:, None] == 0, 1, 2) / 8) * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    order = _zigzag()

    def blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
        t = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        return np.rint((basis @ t @ basis.T).reshape(*t.shape[:2], 64) / table).astype(int)[..., order]

    tables = [_quality(LUMA, q), _quality(CHROMA, q)]
    planes = [blocks(y - 128, tables[0]), blocks(cb, tables[1]), blocks(cr, tables[1])]
    dc, ac = _huffman(DC_COUNTS, DC_VALUES), _huffman(AC_COUNTS, AC_VALUES)
    bits: list[str] = []

    def put(table: dict, symbol: int, value: int = 0, size: int = 0) -> None:
        code, length = table[symbol]
        bits.append(format(code, f"0{length}b"))
        if size:
            bits.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))

    last = [0, 0, 0]

    def block(c: int, z: np.ndarray) -> None:
        diff, last[c] = int(z[0]) - last[c], int(z[0])
        put(dc, n := abs(diff).bit_length(), diff, n)
        run = 0
        where = np.flatnonzero(z[1:]) + 1
        prev = 0
        for i in where.tolist():
            run = i - prev - 1
            while run > 15:
                put(ac, 0xF0)
                run -= 16
            v = max(min(int(z[i]), 1023), -1023)
            put(ac, run << 4 | (n := abs(v).bit_length()), v, n)
            prev = i
        if prev < 63:
            put(ac, 0x00)

    for my in range(planes[1].shape[0]):
        for mx in range(planes[1].shape[1]):
            for dy in (0, 1):
                for dx in (0, 1):
                    block(0, planes[0][2 * my + dy, 2 * mx + dx])
            block(1, planes[1][my, mx])
            block(2, planes[2][my, mx])
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    body = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""
    seg = lambda tag, data: b"\xff" + bytes([tag]) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for n, t in enumerate(tables):
        out += seg(0xDB, bytes([n]) + bytes(t[order].tolist()))
    out += seg(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += seg(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES])) + seg(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES]))
    return out + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
