"""Number arrays and word lists as small binaries, for the packets that tasks exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LEVEL = 6
#: Bytes that hold the length of what was compressed.
_LENGTH = 8


def squeeze(data: bytes) -> bytes:
    """``data`` compressed, its length in front."""
    return len(data).to_bytes(_LENGTH, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[_LENGTH:], int.from_bytes(data[:_LENGTH], "little"), codec="zstd", asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """Whole or floating numbers: bytes of equal weight side by side, so that sorted or small ones shrink."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    return values.dtype.str.encode().ljust(4) + squeeze(values.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:4].strip().decode())
    raw = np.frombuffer(unsqueeze(data[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers, none negative, in 32 bits where they fit."""
    return values.astype(np.uint32) if values.size == 0 or int(values.max()) < 1 << 32 else values.astype(np.uint64)
