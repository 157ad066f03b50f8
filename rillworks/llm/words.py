"""Words of whole texts as bytes, and hashes over runs of words, for use inside tasks."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of a large string array without NULLs, cut from its buffer: many short values at once."""
    _, at, data = column.buffers()
    if not len(column):
        return []
    at = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    text = data.to_pybytes() if data else b""
    return [text[i:j] for i, j in zip(at, at[1:])]


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 9 to 13: what bytes.split() cuts at."""
    return text.split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 with seed 42 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def rolling(w: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of k values: a polynomial modulo 2^64 from prefix sums, then mixed. Empty if there are fewer."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    up, down = np.full(len(w), base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * np.cumprod(up), out=total[1:])
    return mixed((total[k:] - total[:n]) * np.cumprod(down))
