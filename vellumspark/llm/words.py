"""Words of an Arrow text batch as 64-bit hashes, leaving aside case, accents and punctuation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .chars import code_points

_TOP = 0x10000
_NONE, _MARK = 0, 1


@lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the plain lower-case letter or digit (0: no part of a word, 1: a mark inside one), and hash weights."""
    table = np.zeros(_TOP, np.uint32)
    for c in range(_TOP):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind == "Nd":
            base = unicodedata.normalize("NFKD", ch.lower())[:1]
            base = {"đ": "d", "ð": "d"}.get(base, base)
            table[c] = ord(base) if base else c
        elif kind in ("Mn", "Cf"):
            table[c] = _MARK
    weight = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
    return table, weight


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word bounds of each row, start of each word in its row, is it a number).

    Starts are code points from the row's begin.  Null texts have no words.
    """
    table, weight = _fold()
    points, bounds = code_points(texts)
    plain = np.where(points < _TOP, table[np.minimum(points, _TOP - 1)], 0)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.flatnonzero(plain != _MARK)
    plain, row = plain[at], row[at]
    inside = plain > 1
    first = inside.copy()
    if len(first):
        first[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    word = np.cumsum(first) - 1
    keep = inside
    p, w = plain[keep], word[keep]
    step = np.arange(len(plain))[keep] - starts[w] if len(starts) else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = (p.astype(np.uint64) + np.uint64(0x9E3779B9)) * weight[step & 63] ^ (step >> 6).astype(np.uint64)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1]) if len(w) else np.empty(0, np.int64)
        hashes = np.add.reduceat(mixed, begin) if len(begin) else np.empty(0, np.uint64)
    digit = (p >= 0x30) & (p <= 0x39)
    number = np.add.reduceat(digit.astype(np.int64), begin) > 0 if len(begin) else np.empty(0, bool)
    count = np.bincount(row[starts], minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
    return hashes, np.concatenate([[0], np.cumsum(count)]).astype(np.int64), at[starts] - bounds[row[starts]], number


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads sums over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words inside a row, index of its first word)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for k in range(size):
            key = mix(key * np.uint64(31) + hashes[k : n + k])
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(n) + size <= row_end[:n])
    return key[at], at
