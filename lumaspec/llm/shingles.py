"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import SpanHasher, mix64

U64 = np.uint64
_HASHER = SpanHasher()
_BYTES = mix64(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than blank and 0x09-0x0D, A-Z lower-cased) of all texts, and each text's first word (and the end)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends_of = np.cumsum(sizes)
    data = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    n = len(data)
    word = np.zeros(n + 2, dtype=bool)
    word[1 : n + 1] = ~_BLANK[data]
    begins = word[1:] & ~word[:-1]
    first = (ends_of - sizes)[sizes > 0]
    begins[first] |= word[first + 1]
    stops = np.zeros(n + 1, dtype=bool)
    stops[1:] = word[1 : n + 1] & ~word[2:]
    last = ends_of[sizes > 0]
    stops[last] |= word[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    hashes = _HASHER(data, starts, ends, _BYTES) if len(starts) else np.zeros(0, dtype=U64)
    return hashes, np.searchsorted(starts, np.concatenate([[0], ends_of]))


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, end to end, and where each text's begin (and the end).

    A text of fewer words has its whole sequence as its only shingle; one
    without words has none.
    """
    w, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    full = np.maximum(counts - words + 1, 0)
    n_of = np.where(full > 0, full, np.minimum(counts, 1))
    total = int(n_of.sum())
    begin = np.cumsum(n_of) - n_of
    doc = np.repeat(np.arange(len(texts)), n_of)
    at = np.arange(total) - begin[doc] + bounds[:-1][doc]
    padded = np.concatenate([w, np.zeros(words, dtype=U64)])
    out = np.minimum(counts, words)[doc].astype(U64)
    some_short = bool((counts < words).any())
    with np.errstate(over="ignore"):
        for j in range(words):
            word = padded[at + j]
            if some_short:
                word = np.where(counts[doc] <= j, U64(0), word)
            out = mix64(out * U64(0x9E3779B97F4A7C15) + word)
    parts = [np.unique(out[a : a + n]) for a, n in zip(begin.tolist(), n_of.tolist(), strict=True)]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return (np.concatenate(parts) if parts else out), np.concatenate([[0], np.cumsum(sizes)])
