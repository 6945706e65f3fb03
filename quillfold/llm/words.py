"""Vectorised word hashing over Arrow batches of whole texts.

A word is a run of bytes other than space and \\x09-\\x0D, which never split a UTF-8
character. Every word gets a 64-bit hash: a polynomial of its bytes modulo 2**64, read
off prefix sums, then mixed. Word sequences are hashed by combining word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are hashed in slices of about this many bytes, one text at least: that bounds memory.
SLICE = 1 << 20

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_R = U(0x9E3779B97F4A7C15)
_RI = U(pow(int(_R), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Odd multipliers that make the combination of hashes depend on their order.
_C = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, SLICE + (1 << 16))
        up = np.full(size, _R, U)
        down = np.full(size, _RI, U)
        up[0] = down[0] = U(1)
        _POW[:] = [np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)]
    return _POW[0], _POW[1]


class Words:
    """The words of some texts: byte spans, hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data, n = data, len(data)
        word = ~_SPACE[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            edge = bounds[(bounds > 0) & (bounds < n)]
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        up, down = _powers(n + 1)
        table = _LOWER if lower else _BYTE
        sums = np.zeros(n + 1, U)
        np.cumsum(table[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U) * _C[0])
        self.first = np.searchsorted(self.start, bounds)

    def text(self, i: int, keep: np.ndarray | None = None) -> list[bytes]:
        """The words of text i as bytes, or those of them that keep marks."""
        a, b = self.first[i], self.first[i + 1]
        start, end = self.start[a:b], self.end[a:b]
        if keep is not None:
            start, end = start[keep], end[keep]
        if not len(start):
            return []
        lo = int(start[0])
        raw = self.data[lo : int(end[-1])].tobytes()
        return [raw[s:e] for s, e in zip((start - lo).tolist(), (end - lo).tolist(), strict=True)]


def slices(batch: pa.RecordBatch, column: str, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) over a batch; null texts have no words."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
        to = min(to, n)
        yield at, to, Words(data[off[at] : off[to]], (off[at : to + 1] - off[at]), lower)
        at = to


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive hashes (fewer than k: none)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m] * _C[1]
    for j in range(1, k):
        out = out + h[j : m + j] * _C[1 + j]
    return mix(out)


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two adjoining runs from the hashes of each."""
    return mix(left * _C[50] + (right ^ _C[51]) * _C[52])


def whole(h: np.ndarray, salt: int = 53) -> np.uint64:
    """One hash of a whole sequence of any length; each salt (up to 62) gives a hash of its own."""
    up, _ = _powers(len(h) + 1)
    total = int(np.sum(mix(h ^ _C[salt]) * up[: len(h)], dtype=U)) + len(h) * int(_C[salt + 1])
    return mix(np.array([total % 2**64], U))[0]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
