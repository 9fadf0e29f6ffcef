"""FITS frames: header cards, pixel decode by BITPIX, and a writer."""

from __future__ import annotations

import re

import numpy as np

BLOCK, CARD = 2880, 80
# Pixel types of the format, and the colour-filter names it may state.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
PATTERNS = ("RGGB", "BGGR", "GBRG", "GRBG")
NUMBERS = {"BITPIX": 16, "NAXIS": 2, "NAXIS1": 0, "NAXIS2": 0, "NAXIS3": 0}


def cards(data: bytes) -> tuple[list[str], int]:
    """(cards before END, offset of the data)."""
    out = []
    for at in range(0, len(data), CARD):
        card = data[at : at + CARD].decode("latin-1")
        if card[:8].rstrip() == "END":
            return out, -(-(at + CARD) // BLOCK) * BLOCK
        out.append(card)
    raise ValueError("no END card")


def value(card: str) -> str:
    """The value field of a card: quoted text without quotes, else what stands before a comment."""
    text = card.partition("=")[2].strip()
    if text.startswith("'"):
        return text[1:].partition("'")[0].rstrip()
    return text.partition("/")[0].strip()


def header(data: bytes) -> dict:
    """Shape, type, scaling, filter pattern and orientation; raises on what can't be decoded."""
    found, start = cards(data)
    meta = {"bitpix": None, "axes": 0, "w": 0, "h": 0, "planes": 0, "bzero": 0.0, "bscale": 1.0, "bayer": None, "order": None, "start": start}
    integer = lambda v: int(m.group()) if (m := re.match(r"[+-]?\d+", v)) else 0
    number = lambda v: float(m.group()) if (m := re.match(r"[+-]?(\d+\.?\d*|\.\d+)([Ee][+-]?\d+)?", v)) else 0.0
    fields = (("BITPIX", "bitpix", integer), ("NAXIS1", "w", integer), ("NAXIS2", "h", integer), ("NAXIS3", "planes", integer), ("NAXIS", "axes", integer), ("BZERO", "bzero", number), ("BSCALE", "bscale", number), ("BAYERPAT", "bayer", str), ("ROWORDER", "order", str))
    for card in found:
        for name, key, kind in fields:
            if card.startswith(name) and (name != "NAXIS" or not card[5:6].isdigit()):
                meta[key] = kind(value(card))
                break
    if meta["bitpix"] is None or meta["axes"] < 2 or meta["w"] <= 0 or meta["h"] <= 0:
        raise ValueError("BITPIX and two positive axes are needed")
    if meta["bitpix"] not in TYPES:
        raise ValueError(f"BITPIX {meta['bitpix']} isn't supported")
    if meta["axes"] >= 3 and meta["planes"] not in (0, 1, 3):
        raise ValueError(f"{meta['planes']} planes aren't supported")
    meta["channels"] = 3 if meta["axes"] >= 3 and meta["planes"] == 3 else 1
    meta["bayer"] = meta["bayer"] if meta["bayer"] in PATTERNS else None
    meta["flip"] = (meta["order"] or "").upper() != "TOP-DOWN"
    return meta


def decode(data: bytes, real: type = np.float32) -> tuple[dict, np.ndarray]:
    """(header, pixels as uint16 or ``real`` of shape (channels, h, w))."""
    meta = header(data)
    shape = (meta["channels"], meta["h"], meta["w"])
    raw = np.frombuffer(data, TYPES[meta["bitpix"]], int(np.prod(shape)), meta["start"]).reshape(shape)
    zero, scale = meta["bzero"], meta["bscale"]
    if meta["bitpix"] == 16:
        if scale == 1.0 and zero in (32768.0, 0.0):
            out = raw.astype(np.int16).view(np.uint16) ^ np.uint16(0x8000 if zero else 0)
        else:
            out = np.clip(zero + scale * raw.astype(float), 0, 65535).astype(np.uint16)
    elif meta["bitpix"] == 8:
        out = np.clip((zero + scale * raw.astype(float)) * 256, 0, 65535).astype(np.uint16)
    else:
        out = (zero + scale * raw.astype(np.float64)).astype(real)
    return meta, out


def holds(pixels: np.ndarray, bitpix: int, bzero: float = 0.0) -> bool:
    """Whether an integer type can store all the pixels less ``bzero``; none stores NaN."""
    limits, raw = np.iinfo(TYPES[bitpix]), pixels.astype(float) - bzero
    return bool(((raw >= limits.min) & (raw <= limits.max)).all())


def encode(pixels: np.ndarray, bitpix: int, bzero: float = 0.0, extra: dict[str, str] | None = None) -> bytes:
    """A file of (channels, h, w) pixels as they are to be stored, less ``bzero``."""
    c, h, w = pixels.shape
    fields = {"SIMPLE": "T", "BITPIX": str(bitpix), "NAXIS": "3" if c > 1 else "2", "NAXIS1": str(w), "NAXIS2": str(h)} | ({"NAXIS3": str(c)} if c > 1 else {}) | {"BZERO": f"{bzero:.1f}", "BSCALE": "1.0"} | (extra or {})
    text = "".join(f"{k:<8}= {v:>20}".ljust(CARD) for k, v in fields.items()) + "END".ljust(CARD)
    body = (pixels.astype(float) - bzero).astype(TYPES[bitpix]).tobytes()
    pad = lambda b, fill: b + fill * (-len(b) % BLOCK)
    return pad(text.encode("latin-1"), b" ") + pad(body, b"\0")
