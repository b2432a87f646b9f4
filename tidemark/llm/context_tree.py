"""Context-tree weighting over bytes: the tree of one set of counts, in arrays.

A symbol (a byte, or END) is eight binary decisions; decision ``h`` (1 to 255, the bits
so far behind a leading one) has a context tree of its own, whose node at depth d is the
d bytes before the symbol. A node with counts (a, b) estimates by Krichevsky-Trofimov.
With ``Pk`` the node's KT block probability and ``Pw`` that of its weighted subtree,

    Pw(node) = Pk(node)                                     at the greatest depth
    Pw(node) = 1/2 Pk(node) + 1/2 product of Pw(children)   elsewhere.

After training a bit has probability ``share * kt + (1 - share) * that of the child`` with
``share = Pk / (2 Pw)``; a context without counts says one half.

A gram is a context and a symbol in one integer: the byte just before the symbol highest,
then the byte before that, and so on, the symbol lowest. In sorted order the nodes of
every depth are runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Never part of UTF-8: ends every text, and stands before its first byte.
END = 0xFF
_HALF = math.log(0.5)
_TABLE = np.array([math.lgamma(i / 2) if i else 0.0 for i in range(1 << 14)])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of gamma for positive multiples of one half."""
    i = np.minimum((2 * x).astype(np.int64), len(_TABLE) - 1)
    big = np.maximum(x, 1024.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(2 * x < len(_TABLE), _TABLE[i], series)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT probability of a block with ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


@dataclass
class Level:
    """The nodes of one depth: sorted keys ``context << 8 | h``, counts, log Pw."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_w: np.ndarray

    def shares(self) -> np.ndarray:
        """Weight of a node's own estimate against its children's."""
        return np.minimum(1.0, np.exp(_HALF + log_kt(self.zeros, self.ones) - self.log_w))


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each value added up by key."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def nodes(contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, zeros and ones of the decisions of (context, symbol, count) rows."""
    keys, zeros, ones = [], [], []
    for bit in range(8):
        h = (1 << bit) | (symbols >> (8 - bit))
        one = (symbols >> (7 - bit)) & 1
        k, z, o = summed((contexts << 8) | h, counts * (1 - one), counts * one)
        keys.append(k), zeros.append(z), ones.append(o)
    return summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def weigh(keys, zeros, ones, below: np.ndarray | None) -> Level:
    """A level from its counts and, but at the greatest depth, its children's summed log Pw."""
    own = log_kt(zeros, ones)
    return Level(keys, zeros, ones, own if below is None else _HALF + np.logaddexp(own, below))


def gathered(level: Level) -> tuple[np.ndarray, ...]:
    """Keys, zeros, ones and children's log Pw of the level above, from this one."""
    parents = (level.keys >> 16 << 8) | (level.keys & 255)
    return summed(parents, level.zeros, level.ones, level.log_w)


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, top: int = 0) -> list[Level]:
    """Levels ``top`` to ``depth`` of the tree of sorted grams with their counts (some 0)."""
    seen = counts > 0
    out = [weigh(*nodes(grams[seen] >> 8, grams[seen] & 255, counts[seen].astype(np.float64)), None)]
    while len(out) <= depth - top:
        out.append(weigh(*gathered(out[-1])))
    return out[::-1]


def log2_probabilities(grams: np.ndarray, tree: list[Level]) -> np.ndarray:
    """log2 of the probability of each gram's symbol behind its context.

    ``tree`` holds the levels from depth 0 on; the last one is the greatest depth.
    """
    contexts, symbols = grams >> 8, grams & 255
    depth = len(tree) - 1
    total = np.zeros(len(grams))
    shares = [level.shares() for level in tree[:-1]] + [np.ones(len(tree[-1].keys))]
    for bit in range(8):
        h = (1 << bit) | (symbols >> (8 - bit))
        one = ((symbols >> (7 - bit)) & 1).astype(bool)
        p = np.full(len(grams), 0.5)
        for d in range(depth, -1, -1):
            level = tree[d]
            if not len(level.keys):
                continue
            key = (contexts >> (8 * (depth - d)) << 8) | h
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            a, b = level.zeros[at], level.ones[at]
            kt = (np.where(one, b, a) + 0.5) / (a + b + 1.0)
            p = np.where(level.keys[at] == key, p + shares[d][at] * (kt - p), 0.5)
        total += np.log2(p)
    return total


def text_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and END of the texts, and each text's first position."""
    end = bytes([END])
    joined = np.frombuffer(b"".join(end * depth + t + end for t in texts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(texts)) * depth, lengths)
    whole = joined[depth:].copy()
    for back in range(1, depth + 1):
        whole |= joined[depth - back:len(joined) - back] << (8 * (depth + 1 - back))
    return whole[at], starts
