"""Pictures as arrays: PNG, PNM (P5, P6) and BMP files of 8 bits a channel, in numpy and zlib alone.

Arrays are height x width x 3 uint8 in B, G, R order. JPEG and PDF need a decoder of the
caller's own (see Rasteriser in operators/vision.py).
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(content: bytes) -> np.ndarray:
    """The picture; ValueError if it is none that can be read here."""
    try:
        if content.startswith(PNG):
            return _png(content)
        if content[:2] in (b"P5", b"P6"):
            return _pnm(content)
        if content[:2] == b"BM":
            return _bmp(content)
    except (struct.error, zlib.error, IndexError, KeyError) as x:
        raise ValueError(f"broken picture: {x}") from x
    raise ValueError("unknown kind of picture")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filters of PNG rows (type, then bytes); step: bytes of a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].astype(np.int32)
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.int32)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows, strict=True)):
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.cumsum(row.reshape(-1, step), 0).reshape(-1) & 255
        elif kind == 2:
            now = (row + above) & 255
        elif kind in (3, 4):
            now = row.copy()
            for x in range(len(now)):
                left = int(now[x - step]) if x >= step else 0
                up, corner = int(above[x]), int(above[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    near = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(near - v))
                now[x] = (now[x] + guess) & 255
        else:
            raise ValueError("unknown filter")
        out[y] = above = now
    return out.astype(np.uint8)


def _png(content: bytes) -> np.ndarray:
    at, data, palette = len(PNG), b"", None
    width, height, depth, colour, *_, interlaced = struct.unpack(">IIBBBBB", content[16:29])
    if depth != 8 or interlaced:
        raise ValueError("only plain pictures of 8 bits")
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            data += body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        at += 12 + size
    channels = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    if len(raw) != height * (1 + width * channels):
        raise ValueError("cut short")
    img = _unfiltered(raw.reshape(height, -1), channels).reshape(height, width, channels)
    if colour == 3:
        return np.ascontiguousarray(palette[img[..., 0]][..., ::-1])
    return _bgr(img[..., :3] if channels >= 3 else img[..., :1])


def _bgr(img: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.repeat(img, 3, 2) if img.shape[2] == 1 else img[..., ::-1])


def _pnm(content: bytes) -> np.ndarray:
    head = re.match(rb"(P[56])(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s", content)
    if not head or int(head[4]) != 255:
        raise ValueError("only plain pictures of 8 bits")
    channels, width, height = 3 if head[1] == b"P6" else 1, int(head[2]), int(head[3])
    body = np.frombuffer(content, np.uint8, offset=head.end())
    if len(body) < width * height * channels:
        raise ValueError("cut short")
    return _bgr(body[: width * height * channels].reshape(height, width, channels))


def _bmp(content: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", content[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("only plain pictures of 8 bits")
    stride = -(-width * bits // 32) * 4
    body = np.frombuffer(content, np.uint8, offset=start)
    if len(body) < stride * abs(height):
        raise ValueError("cut short")
    img = body[: stride * abs(height)].reshape(abs(height), stride)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., :3]
    return np.ascontiguousarray(img[::-1] if height > 0 else img)


def encode_png(img: np.ndarray) -> bytes:
    """A PNG of a picture (B, G, R) or of one plane."""
    rows = img[..., ::-1] if img.ndim == 3 else img[..., None]
    height, width, channels = rows.shape
    raw = np.zeros((height, 1 + width * channels), np.uint8)
    raw[:, 1:] = rows.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")
