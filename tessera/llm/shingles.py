"""Vectorised word shingles and min-max signatures over whole batches of texts.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lowered. A word's hash is a
polynomial of its bytes, each replaced by a random 64-bit value, from one running sum over the
text; a shingle's hash mixes its words' hashes in order. All hashes are 64 bits and fixed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240601)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once.
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of ``raw`` (uint8)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[raw]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def text_words(raw: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, hashed in segments that end between words."""
    if len(raw) <= SEGMENT:
        return word_hashes(raw)[0]
    out, at = [], 0
    while at < len(raw):
        end, look = min(len(raw), at + SEGMENT), SEGMENT
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end : end + look]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + look)
        out.append(word_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of ``k`` words, repeats included; of fewer words, the one of them all."""
    if not len(words):
        return words
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * _ORDER[i]
    return mix(h)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return np.unique(shingle_hashes(text_words(raw), k))


class MinMax:
    """Min-max signatures: ``permutations`` hash functions give twice as many values."""

    def __init__(self, permutations: int, rows: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**64, permutations, dtype=np.uint64)
        self.rows, self.bands = rows, 2 * permutations // rows

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, values): for texts whose hashes begin at ``starts``; none may be empty."""
        out = np.empty((2 * len(self.a), len(starts)), dtype=np.uint64)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            v = hashes * a + b
            out[i] = np.minimum.reduceat(v, starts)
            out[len(self.a) + i] = np.maximum.reduceat(v, starts)
        return out.T

    def buckets(self, signatures: np.ndarray) -> np.ndarray:
        """(texts, bands): a hash of each band's values and its number."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows)
        h = np.arange(self.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h + (parts * _ORDER[: self.rows]).sum(axis=2, dtype=np.uint64))

    def sketches(self, signatures: np.ndarray) -> np.ndarray:
        """(texts, values) as single bytes, for estimates."""
        return np.ascontiguousarray((mix(signatures) & np.uint64(255)).astype(np.uint8))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities by sketches (rows), less what equal bytes give by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)
