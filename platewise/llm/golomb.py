"""Golomb-Rice codes of sorted whole numbers."""

from __future__ import annotations

import math

import numpy as np


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct ``values`` in [0, span) as Golomb-Rice codes: one byte
    for the divisor's exponent, the unary quotients, then the remainders."""
    n = len(values)
    k = max(0, math.floor(math.log2(max(1.0, span / max(n, 1) * math.log(2)))))
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    head = np.array([k], np.uint8).tobytes()
    return head + np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def golomb_decode(code: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``golomb_encode`` coded."""
    k = code[0]
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=1))
    ends = np.flatnonzero(bits[: len(bits) - n * k])[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1 if n else 0
    low = bits[start:start + n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients.astype(np.int64) << k) + (low << np.arange(k)).sum(axis=1))
