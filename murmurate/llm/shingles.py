"""Sets of word shingles as 64-bit hashes that agree between processes."""

from __future__ import annotations

SHINGLE = 5
_CACHE_WORDS, _CACHE_BYTES = 100_000, 32
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHE_BYTES:
            self[word] = value
        return value


_hashes = _WordHashes()


def shingle_set(text: str | None):
    """Sorted distinct 64-bit hashes of the five-word shingles of a text, A-Z lowered; of fewer
    words, of all of them as one; none without a word."""
    import numpy as np

    words = text.encode().lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(ids) - SHINGLE + 1
    if n < 1:
        h = np.array([len(ids)], np.uint64)
        for i, m in zip(ids, _MULTIPLIERS, strict=False):
            h = (h ^ i) * np.uint64(m)
            h ^= h >> np.uint64(31)
        return h
    h = ids[:n] * np.uint64(_MULTIPLIERS[0])
    for k in range(1, SHINGLE):
        h += ids[k : k + n] * np.uint64(_MULTIPLIERS[k])
        h ^= h >> np.uint64(29)
    h *= np.uint64(_MULTIPLIERS[1])
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
