"""Pixels: sizes from headers, letterboxes, resizing, crops, grids and boxes on RGB arrays.

Decoding needs a decoder; Pillow is used if it is installed, or the caller hands one in. All
else is numpy on ``uint8`` arrays of shape (height, width, 3).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np


def header_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG or PNG from its header; None where it cannot be read."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def decode(data: bytes, decoder: Callable[[bytes], np.ndarray] | None = None) -> np.ndarray:
    """RGB pixels of an encoded picture."""
    if decoder is not None:
        return np.asarray(decoder(data), np.uint8)
    try:
        from io import BytesIO

        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding pictures needs Pillow or a decoder of your own") from e
    return np.asarray(Image.open(BytesIO(data)).convert("RGB"))


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def _weights(old: int, new: int) -> np.ndarray:
    scale = old / new
    support = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale - 0.5
    w = _cubic((np.arange(old)[None] - centre[:, None]) / support)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, nearest: bool = False) -> np.ndarray:
    """Bicubic, or nearest neighbour; the same array where nothing changes."""
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image
    if nearest:
        return image[(np.arange(height) * h // height)[:, None], (np.arange(width) * w // width)[None]]
    out = np.einsum("yh,hwc->ywc", _weights(h, height), image.astype(float))
    out = np.einsum("xw,ywc->yxc", _weights(w, width), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def letterbox(image: np.ndarray, fill: int = 0) -> tuple[np.ndarray, int]:
    """(square picture with the image in its middle, rows of padding above)."""
    h, w = image.shape[:2]
    side = max(h, w)
    top, left = (side - h) // 2, (side - w) // 2
    out = np.full((side, side, 3), fill, np.uint8)
    out[top : top + h, left : left + w] = image
    return out, top


def preprocess(data: bytes, target: int = 518, min_bytes: int = 4096, size: tuple[int, int] = (640, 360), decoder: Callable | None = None) -> dict:
    """Checked, letterboxed and resized picture with what is known of its source."""
    if len(data) < min_bytes:
        raise ValueError(f"too_small:{len(data)}B")
    image = decode(data, decoder)
    h, w = image.shape[:2]
    if (w, h) != size:
        raise ValueError(f"unexpected_size:{w}x{h}")
    square, top = letterbox(image)
    return {"image": resize(square, target, target), "file": {"bytes": len(data), "width": w, "height": h}, "frame": {"side": square.shape[0], "above": top, "target": target}}


def normalise(image: np.ndarray, mean: tuple[float, float, float] = (0.485, 0.456, 0.406), std: tuple[float, float, float] = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Channels first, scaled to unit range and standardised."""
    return ((image / 255.0 - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def png(image: np.ndarray) -> bytes:
    """A picture of bytes in three channels as a PNG file."""
    h, w = image.shape[:2]

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, 3 * w)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def crop_cell(image: np.ndarray, row: int, col: int, patch: int = 16, upscale: int = 8) -> np.ndarray:
    cell = image[row * patch : (row + 1) * patch, col * patch : (col + 1) * patch]
    return resize(cell, cell.shape[1] * upscale, cell.shape[0] * upscale, nearest=True)


def grid(images: list[np.ndarray], height: int = 90, columns: int = 4) -> np.ndarray:
    """Pictures of one height in rows, on black."""
    small = [resize(i, max(1, round(i.shape[1] * height / i.shape[0])), height) for i in images]
    rows = [small[k : k + columns] for k in range(0, len(small), columns)]
    out = np.zeros((height * max(len(rows), 1), max((sum(i.shape[1] for i in r) for r in rows), default=1), 3), np.uint8)
    for y, r in enumerate(rows):
        x = 0
        for i in r:
            out[y * height : (y + 1) * height, x : x + i.shape[1]] = i
            x += i.shape[1]
    return out


def box(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, colour: tuple[int, int, int] = (255, 0, 0), line: int = 2) -> np.ndarray:
    """A copy with a rectangle drawn on it."""
    out = image.copy()
    for a in range(line):
        out[y0 + a, x0:x1] = out[y1 - 1 - a, x0:x1] = colour
        out[y0:y1, x0 + a] = out[y0:y1, x1 - 1 - a] = colour
    return out
