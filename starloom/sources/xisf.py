"""XISF frames: XML header, attached or embedded data block, compression, byte shuffling, and a writer."""

from __future__ import annotations

import base64
import re
import struct
import zlib

import numpy as np
import pyarrow as pa

SIGNATURE = b"XISF0100"
MOST_XML = 100 << 20
# Sample formats with the factor to 16-bit units; an unknown name reads as Float32.
FORMATS = {"UInt8": ("<u1", 257.0), "UInt16": ("<u2", 1.0), "UInt32": ("<u4", 1 / 65536), "Float32": ("<f4", 65535.0), "Float64": ("<f8", 65535.0)}
PATTERNS = ("RGGB", "BGGR", "GBRG", "GRBG")


def unshuffle(data: bytes, item: int) -> bytes:
    """Undoes byte shuffling; a tail shorter than an item stays as it is."""
    n = len(data) // item
    whole = np.frombuffer(data, np.uint8, n * item).reshape(item, n).T.tobytes()
    return whole + data[n * item :]


def shuffle(data: bytes, item: int) -> bytes:
    n = len(data) // item
    return np.frombuffer(data, np.uint8, n * item).reshape(n, item).T.tobytes() + data[n * item :]


def header(data: bytes) -> dict:
    """Attributes of the first Image element."""
    if data[:8] != SIGNATURE:
        raise ValueError("not an XISF file")
    (size,) = struct.unpack_from("<I", data, 8)
    if not 0 < size <= MOST_XML:
        raise ValueError("XML header of an impossible size")
    xml = data[16 : 16 + size].decode("utf-8", "replace").rstrip("\0")
    image = re.search(r"<Image\b([^>]*)>", xml)
    if not image:
        raise ValueError("no Image element")
    attrs = dict(re.findall(r"([\w:]+)\s*=\s*\"([^\"]*)\"", image.group(1)))
    w, h, *c = map(int, attrs["geometry"].split(":"))
    codec, *parts = attrs["compression"].split(":") if attrs.get("compression") else ("none",)
    return {
        "w": w,
        "h": h,
        "channels": c[0] if c else 1,
        "format": attrs.get("sampleFormat", "Float32") if attrs.get("sampleFormat") in FORMATS else "Float32",
        "normal": attrs.get("pixelStorage", "Planar").lower() == "normal",
        "location": attrs.get("location", "embedded"),
        "codec": codec,
        "sizes": [int(x) for x in parts],
        "bayer": next((p for p in PATTERNS if p in xml), None),
        "flip": False,
        "embedded": re.search(r"<Data\b[^>]*>([^<]*)</", xml[image.end() :]),
    }


def decompress(block: bytes, codec: str, size: int) -> bytes:
    name = codec.removesuffix("+sh")
    if name == "none":
        return block
    if name == "zlib":
        d = zlib.decompressobj()
        out = d.decompress(block)
        return out if d.eof else zlib.decompress(block, -15)  # a cut stream may be raw deflate
    if name in ("lz4", "lz4hc"):
        out = pa.Codec("lz4_raw").decompress(block, decompressed_size=size).to_pybytes()
    elif name == "zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(block, max_output_size=max(size, 1))
    else:
        raise ValueError(f"unknown compression {codec}")
    if len(out) != size:
        raise ValueError(f"block has {len(out)} bytes, header says {size}")
    return out


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """(header, pixels as float32 of shape (channels, h, w) in 16-bit units)."""
    meta = header(data)
    kind, factor = FORMATS[meta["format"]]
    dtype = np.dtype(kind)
    count = meta["w"] * meta["h"] * meta["channels"]
    if meta["location"].startswith("attachment"):
        _, at, size = meta["location"].split(":")
        block = data[int(at) : int(at) + int(size)]
    elif meta["embedded"]:
        block = base64.b64decode(re.sub(r"\s", "", meta["embedded"].group(1)))
    else:
        raise ValueError("no data block")
    plain = decompress(block, meta["codec"], meta["sizes"][0] if meta["sizes"] else len(block))
    if meta["codec"].endswith("+sh"):
        plain = unshuffle(plain, meta["sizes"][1] if len(meta["sizes"]) > 1 else dtype.itemsize)
    raw = np.frombuffer(plain, dtype, count)
    raw = raw >> 16 if meta["format"] == "UInt32" else raw
    values = raw.astype(np.float32) * np.float32(1.0 if meta["format"] == "UInt32" else factor)
    h, w, c = meta["h"], meta["w"], meta["channels"]
    out = values.reshape(h, w, c).transpose(2, 0, 1) if meta["normal"] and c == 3 else values.reshape(c, h, w)
    return {k: v for k, v in meta.items() if k != "embedded"}, np.ascontiguousarray(out)


def encode(pixels: np.ndarray, form: str, codec: str = "none", embedded: bool = False) -> bytes:
    """A file of (channels, h, w) pixels stored in the named sample format."""
    c, h, w = pixels.shape
    plain = pixels.astype(FORMATS[form][0]).tobytes()
    item, name = np.dtype(FORMATS[form][0]).itemsize, codec.removesuffix("+sh")
    block = shuffle(plain, item) if codec.endswith("+sh") else plain
    if name == "zlib":
        block = zlib.compress(block)
    elif name in ("lz4", "lz4hc"):
        block = pa.Codec("lz4_raw").compress(block).to_pybytes()
    elif name == "zstd":
        import zstandard

        block = zstandard.ZstdCompressor().compress(block)
    packed = "" if name == "none" and codec == "none" else f' compression="{codec}:{len(plain)}' + (f":{item}" if codec.endswith("+sh") else "") + '"'
    start = 4096
    location = "embedded" if embedded else f"attachment:{start}:{len(block)}"
    inner = f'<Data encoding="base64">{base64.b64encode(block).decode()}</Data>' if embedded else ""
    xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0"><Image geometry="{w}:{h}:{c}" sampleFormat="{form}" location="{location}"{packed}>{inner}</Image></xisf>'.encode()
    head = SIGNATURE + struct.pack("<II", len(xml), 0) + xml
    return head if embedded else head.ljust(start, b"\0") + block
