"""Compact binary columns: arrays of integers as compressed byte planes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """64-bit integers in about as many bytes as their size needs; ``sorted_``: as differences."""
    v = values.astype(np.uint64, copy=False)
    if sorted_ and len(v):
        v = np.concatenate((v[:1], np.diff(v)))
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, sorted_: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if sorted_ else v
