"""Words ``[^\\x20\\x09-\\x0D]+`` of many texts at once, with 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

from siftline.llm.shared import mixed

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words without punctuation: ASCII letters and digits, and all bytes of other characters.
PLAIN = np.ones(256, bool)
PLAIN[:128] = [chr(c).isalnum() for c in range(128)]


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    back = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, back, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_spans(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes that are ``of_word``), and the n + 1 offsets of the texts in the list
    of words. A word never crosses from one text to the next."""
    solid = of_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = solid & (edge[:-1] | np.r_[True, ~solid[:-1]]) if len(data) else solid
    stops = solid & (edge[1:] | np.r_[~solid[1:], True]) if len(data) else solid
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (a polynomial over the bytes, then scrambled)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(18, int(len(data) + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out = out * np.uint64(_BASE) + hashes[k: k + n]
    return mixed(out)
