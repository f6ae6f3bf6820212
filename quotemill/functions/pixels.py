"""Pixels without an image library: PNG (8 bits, not interlaced) and PPM in, PNG out; tiles and montages.

Another decoder (bytes -> array of height x width x 3) can be passed wherever one is used.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """The image as height x width x 3 bytes. Raises ValueError for what it can't read."""
    if data[:8] == _PNG:
        return _decode_png(data)
    if data[:2] == b"P6":
        parts = data.split(None, 4)
        if len(parts) == 5 and parts[3] == b"255":
            w, h = int(parts[1]), int(parts[2])
            at = data.index(b"255", data.index(parts[2], data.index(parts[1], 2) + len(parts[1]))) + 4
            if len(data) - at >= w * h * 3:
                return np.frombuffer(data, np.uint8, w * h * 3, at).reshape(h, w, 3)
    raise ValueError("no PNG or PPM image")


def _decode_png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, b"", None, None
    try:
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            chunk = data[at + 8 : at + 8 + n]
            at += 12 + n
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", chunk)
            elif kind == b"PLTE":
                palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += chunk
        w, h, depth, color, _, _, interlaced = head
        if depth != 8 or interlaced or color not in _CHANNELS:
            raise ValueError("unsupported PNG")
        step = _CHANNELS[color]
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    except (struct.error, zlib.error, TypeError) as e:
        raise ValueError("broken PNG") from e
    out = np.zeros((h, w * step), np.uint8)
    up = np.zeros(w * step, np.uint8)
    for y in range(h):
        line = raw[y, 1:].reshape(w, step)
        out[y] = up = _unfilter(raw[y, 0], line, up.reshape(w, step)).reshape(-1)
    pixels = out.reshape(h, w, step)
    if color == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if color in (0, 4) else pixels[:, :, :3]


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + up
    out = np.zeros_like(line)
    left = corner = np.zeros(line.shape[1], np.int32)
    for x in range(len(line)):
        above = up[x].astype(np.int32)
        if kind == 3:
            guess = (left + above) // 2
        else:
            p = left + above - corner
            a, b, c = abs(p - left), abs(p - above), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        out[x] = (line[x] + guess) & 255
        left, corner = out[x].astype(np.int32), above
    return out


def encode_png(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def crop(image: np.ndarray, box: list[int]) -> np.ndarray:
    """The part of [left, top, right, bottom]."""
    left, top, right, bottom = box
    return image[top:bottom, left:right]


def contained(tile: np.ndarray, size: int) -> np.ndarray:
    """The tile scaled, keeping its proportions, so that it just fits a square (nearest pixels)."""
    h, w = tile.shape[:2]
    scale = size / max(w, h)
    new_w, new_h = max(1, round(w * scale)), max(1, round(h * scale))
    return tile[(np.arange(new_h) * h // new_h)[:, None], (np.arange(new_w) * w // new_w)[None, :]]


def montage(image: np.ndarray, boxes: list[list[int]], size: int = 224) -> np.ndarray:
    """The tiles of the boxes in rows of at most four on white, each centred in its square."""
    if not boxes:
        raise ValueError("no tiles to show")
    cols = min(4, len(boxes))
    canvas = np.full((-(-len(boxes) // cols) * size, cols * size, 3), 255, np.uint8)
    for i, box in enumerate(boxes):
        tile = crop(image, box)
        if tile.size:
            thumb = contained(tile, size)
            y, x = i // cols * size + (size - thumb.shape[0]) // 2, i % cols * size + (size - thumb.shape[1]) // 2
            canvas[y : y + thumb.shape[0], x : x + thumb.shape[1]] = thumb
    return canvas
