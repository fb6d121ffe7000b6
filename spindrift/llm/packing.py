"""Arrays of integers as small blobs, for exchanges that send runs instead of rows."""

from __future__ import annotations

import numpy as np
import zstandard

U = np.uint64


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers: byte planes, the zero ones left out, each compressed if that helps."""
    a = np.ascontiguousarray(a).astype(U)
    top = int(a.max()).bit_length() if len(a) else 0
    planes = -(-top // 8)
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T[:planes]).tobytes() if len(a) else b""
    return len(a).to_bytes(6, "little") + bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> np.ndarray:
    n, planes = int.from_bytes(blob[:6], "little"), blob[6]
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        out[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[7:], max_output_size=n * planes), np.uint8).reshape(planes, n).T
    return out.view(U).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    a = a.astype(U)
    return pack(np.diff(a, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U)


def pack_floats(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, np.float64).tobytes())


def unpack_floats(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.float64)


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of equal width each 64-bit hash is in."""
    return ((hashes >> U(32)) * U(n) >> U(32)).astype(np.int64)


def cuts(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each range begins in ascending hashes, and their end."""
    return np.searchsorted(buckets(sorted_hashes, n), np.arange(n + 1))
