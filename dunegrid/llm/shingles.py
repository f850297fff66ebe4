"""Word shingles of a text as 64-bit hashes, and minwise hashes of their set."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
#: Words whose hash a worker process keeps.
KEPT_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


_WORDS = _WordHashes()


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``words``-word shingles.

    A-Z is lower-cased; words are runs of anything but space and U+0009-000D
    (what ``bytes.split`` splits at).  With fewer words the whole sequence is
    the one shingle; without words the set is empty.
    """
    parts = (text or "").encode().lower().split()
    n = len(parts)
    if n == 0:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > KEPT_WORDS:
        _WORDS.clear()
    w = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, n)
    k = min(words, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j:n - k + 1 + j]) * _M1
        h ^= h >> np.uint64(32)
    return np.unique(_avalanche(h))


def set_id(shingles: np.ndarray) -> bytes:
    """128-bit digest of the whole set: equal sets, equal ids."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


class MinHasher:
    """``count`` minwise hashes of a set: minima of linear maps of the (already
    well mixed) upper 32 bits, one row of the block per map."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, count, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = None
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(high), 2048):
            block = self.a * high[lo:lo + 2048]
            block += self.b
            low = block.min(axis=1)
            out = low if out is None else np.minimum(out, low)
        return out.astype(np.uint64)


def sketch(shingles: np.ndarray, bins: int = 512) -> bytes:
    """One byte per bin of the hash range: 0 where the set has no shingle,
    else 1 ... 255 from the bin's smallest hash (one-permutation hashing)."""
    which = (shingles >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    at, first = np.unique(which, return_index=True)  # the set is sorted
    out = np.zeros(bins, np.uint8)
    out[at] = 1 + (_avalanche(shingles[first]) % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def combine(minima: np.ndarray) -> np.ndarray:
    """One key per row of a (keys, width) array of minima, as int64; rows are
    told apart by their number as well."""
    h = np.arange(1, len(minima) + 1, dtype=np.uint64) * _M2
    for j in range(minima.shape[1]):
        h = (h ^ minima[:, j]) * _M1
        h ^= h >> np.uint64(32)
    return _avalanche(h).view(np.int64)
