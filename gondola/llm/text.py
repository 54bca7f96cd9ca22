"""Texts as byte arrays: slices of bounded size, words and their hashes, in numpy.

Everything here is map-side arithmetic on one Arrow batch; memory follows the
slice (about a megabyte, or one longer text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SLICE = 1 << 20
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


BYTE_CODES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_BASE = 0x5851F42D4C957F2D
_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers modulo 2**64, and those of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * SLICE)
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverse


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes of the texts, one separator byte behind each
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]:bounds[i+1]
    prefix: np.ndarray  # running hash, for spans of bytes


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U))


def words_of(texts: list[bytes], inside: np.ndarray = ~SPACE) -> Words:
    """Runs of bytes in ``inside`` with A-Z lower-cased, and a 64-bit hash of each."""
    joined = b"\n".join(texts) + b"\n"
    data = LOWER[np.frombuffer(joined, np.uint8)]
    is_in = inside[data]
    edges = np.flatnonzero(np.diff(is_in, prepend=False, append=False))
    start, end = edges[0::2], edges[1::2]
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODES[data] * powers(len(data) + 1)[0][: len(data)], out=prefix[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, np.concatenate([[0], ends]))
    return Words(data, start, end, span_hash(prefix, start, end), bounds, prefix)


def letter_words(texts: list[bytes]) -> Words:
    return words_of(texts, LETTER)


def ngram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    count = max(0, len(word) - n + 1)
    total = np.full(count, n, U)
    for i in range(n):
        total = mixed(total + word[i:i + count])
    return total
