"""Word shingles of texts as 64-bit hashes, each word hashed by BLAKE2b once per cache.

Words are byte strings between ASCII white space, A-Z in lower case. A word's number is 64 bits of its BLAKE2b digest, so
equal numbers of different words cannot be had by construction short of a search over about 2**32 words; a shingle mixes the
numbers of its words in order. Sets are compared by these hashes: for a pair of texts with n different shingles the
chance that any two of them fall together is about n * n / 2**65 (3e-14 for a thousand).
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np

WORDS_PER_SHINGLE = 5
SLICE_BYTES, CACHE_WORDS = 1 << 20, 60_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


class _Words(dict):
    """Word -> 64 bits of its digest, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) < 64:
            self[word] = out
        return out


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of x reaches every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(data: bytes):
    """data cut at white space into parts of about SLICE_BYTES; longer words stay whole."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        cut = _SPACE.search(data, at + SLICE_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    parts = []
    for part in _slices((text or "").encode()):
        words = part.lower().split()  # of bytes: lower() knows A-Z only, split() the six white-space characters
        parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts)


def shingle_sets(texts, k: int = WORDS_PER_SHINGLE):
    """The sorted distinct shingle hashes of each text (null: empty), in order."""
    words = [word_hashes(t) for t in texts]
    if not words:
        return
    with np.errstate(over="ignore"):
        every = np.concatenate(words)  # one pass over all texts; the few shingles across two texts are left out below
        n = max(0, len(every) - k + 1)
        h = np.full(n, np.uint64(k))
        for i in range(k if n else 0):
            h = _mix(h * _ODD + every[i : i + n])
        at = 0
        for w in words:
            if len(w) >= k:
                yield np.unique(h[at : at + len(w) - k + 1])
            elif len(w):
                x = np.full(1, np.uint64(len(w)))
                for i in range(len(w)):
                    x = _mix(x * _ODD + w[i : i + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)
            at += len(w)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the digest of a sorted set."""
    d = blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
