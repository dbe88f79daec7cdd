"""Word hashes of texts, computed over arrays of code points instead of word by word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

CHAR_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX = np.uint64(0xBF58476D1CE4E5B9)
BATCH_CHARS = 1 << 19
KEPT_POWERS = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1), modulo 2^64."""
    base &= 2 ** 64 - 1
    kept = _powers.get(base)
    if kept is None or len(kept) < count:
        kept = np.full(max(count, min(KEPT_POWERS, 2 * count)), base, np.uint64)
        kept[:1] = 1
        kept = np.multiply.accumulate(kept)
        if len(kept) <= KEPT_POWERS:
            _powers[base] = kept
    return kept[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def word_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from one rolling hash over the text: two prefix sums differ
    by the span times a power of the base, which the inverse power takes away."""
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * powers(CHAR_BASE, len(points)), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(inverse(CHAR_BASE), len(points) + 1)[start]
    return mixed(mixed(h) + (end - start).astype(np.uint64))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of each n neighbours."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(WORD_BASE, len(hashes)), out=prefix[1:])
    count = len(hashes) - n + 1
    return mixed((prefix[n:] - prefix[:-n]) * powers(inverse(WORD_BASE), count))


@cache
def word_table() -> np.ndarray:
    """Which code points are part of a word: letters, digits and the underscore."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def char_batches(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of together some BATCH_CHARS characters; long texts alone."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > BATCH_CHARS:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def hashed_words(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashes of each text's lower-cased words."""
    table = word_table()
    for batch in char_batches(texts):
        points = code_points("\n".join(t.lower() for t in batch))
        start, end = word_spans(table[points])
        hashes = span_hashes(points, start, end)
        ends = np.cumsum([len(t.lower()) + 1 for t in batch])
        yield from np.split(hashes, np.searchsorted(start, ends[:-1]))
