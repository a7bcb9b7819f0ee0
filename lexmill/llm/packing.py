"""Packed arrays of whole numbers, for rows that carry many of them through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard

LEVEL = 1


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(a: np.ndarray) -> bytes:
    """Numbers from 0 to 2**64 - 1: their bytes plane by plane, as many planes as the largest needs, compressed."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + squeeze(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def pack_bits(a: np.ndarray) -> bytes:
    return squeeze(np.packbits(a).tobytes())


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueeze(raw), np.uint8), count=n).astype(bool)


def pack_ids(a: np.ndarray) -> bytes:
    """Any 64-bit signed numbers, as differences to the smallest."""
    least = int(a.min()) if len(a) else 0
    return least.to_bytes(8, "little", signed=True) + pack(a.astype(np.int64).view(np.uint64) - np.uint64(least % 2**64))


def unpack_ids(raw: bytes) -> np.ndarray:
    least = int.from_bytes(raw[:8], "little", signed=True)
    return (unpack(raw[8:]) + np.uint64(least % 2**64)).view(np.int64)
