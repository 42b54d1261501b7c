"""Compressed bitmaps over ranges of 65,536 integers: positions, bits or runs, whichever is shortest."""

from __future__ import annotations

import numpy as np

RANGE = 1 << 16
_POSITIONS, _BITS, _RUNS = b"p", b"b", b"r"


def encode(positions: np.ndarray) -> bytes:
    """Of ascending distinct positions below RANGE."""
    x = np.asarray(positions, dtype=np.int64)
    breaks = np.flatnonzero(np.diff(x) != 1)
    runs = len(breaks) + 1 if len(x) else 0
    if 4 * runs < min(2 * len(x), RANGE // 8):
        first, last = x[np.append(0, breaks + 1)], x[np.append(breaks, len(x) - 1)]
        return _RUNS + np.stack([first, last], axis=1).astype("<u2").tobytes()
    if 2 * len(x) <= RANGE // 8:
        return _POSITIONS + x.astype("<u2").tobytes()
    bits = np.zeros(RANGE, np.uint8)
    bits[x] = 1
    return _BITS + np.packbits(bits, bitorder="little").tobytes()


def bits(data: bytes | None) -> np.ndarray:
    """The RANGE bits, as booleans; all unset for null."""
    out = np.zeros(RANGE, bool)
    if data is None:
        return out
    kind, body = data[:1], data[1:]
    if kind == _BITS:
        return np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").astype(bool)
    x = np.frombuffer(body, "<u2").astype(np.int64)
    if kind == _POSITIONS:
        out[x] = True
        return out
    edge = np.zeros(RANGE + 1, np.int32)
    edge[x[0::2]] += 1
    edge[x[1::2] + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def decode(data: bytes | None) -> np.ndarray:
    return np.flatnonzero(bits(data))


def and_not(a: bytes | None, b: bytes | None) -> bytes:
    return encode(np.flatnonzero(bits(a) & ~bits(b)))


def both(a: bytes | None, b: bytes | None) -> bytes:
    return encode(np.flatnonzero(bits(a) & bits(b)))
