"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WORDS_PER_SHINGLE = 5
# Bytes hashed at once; texts beyond it are hashed in parts cut at blanks.
SPAN = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, stream: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values of a stream."""
    step = _U(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=_U) + _U(stream << 32)) * step)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A random value per byte, the same for both cases of A to Z."""
    values = seeds(256, 1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@lru_cache(maxsize=1)
def _is_blank() -> np.ndarray:
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return blank


def _span_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every word of ``data``, from prefix sums of a rolling polynomial."""
    word = np.concatenate(([False], ~_is_blank()[data], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    n = max(SPAN, 1 << (max(len(data), 1) - 1).bit_length()) + 1
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_values()[data] * _powers(_BASE, n)[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
    return mix(hashes ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+``, A to Z lower-cased."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= SPAN:
        return _span_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + SPAN, len(data))
        while end < len(data):  # on to the next blank, so that no word is cut
            blanks = np.flatnonzero(_is_blank()[data[end : end + SPAN]])
            if len(blanks):
                end += int(blanks[0])
                break
            end = min(end + SPAN, len(data))
        parts.append(_span_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width_here = min(width, len(words))
    factors = seeds(width, 2 + width - width_here) | _U(1)
    n = len(words) - width_here + 1
    total = np.zeros(n, _U)
    for j in range(width_here):
        total += words[j : j + n] * factors[j]
    return np.unique(mix(total))


class MinHash:
    """Minima of ``n`` universal hash functions over a shingle set."""

    def __init__(self, n: int):
        self.a = (seeds(n, 21) | _U(1))[:, None]
        self.b = seeds(n, 22)[:, None]

    def signature(self, shingles: np.ndarray, span: int = 512) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, _U)
        for i in range(0, len(shingles), span):
            values = self.a * shingles[None, i : i + span]
            values += self.b
            np.minimum(low, values.min(axis=1), out=low)
        return (low >> _U(32)).astype("<u4")


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` minima; the band's number is part of it."""
    bands = signature.reshape(-1, rows).astype(_U)
    factors = seeds(rows + 1, 31) | _U(1)
    total = np.arange(len(bands), dtype=_U) * factors[rows]
    for j in range(rows):
        total = mix(total + bands[:, j] * factors[j])
    return total.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    return len(np.intersect1d(a, b, assume_unique=True))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = overlap(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def recent(texts: Iterator[bytes], keep: int = 256) -> Iterator[np.ndarray]:
    """Shingle sets of ``texts``; those of the last few distinct texts are remembered."""
    known: dict[bytes, np.ndarray] = {}
    for text in texts:
        if text not in known:
            if len(known) >= keep:
                known.pop(next(iter(known)))
            known[text] = shingle_set(text)
        yield known[text]
