"""Word shingles of whole texts as 64-bit hashes, with NumPy over many texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = _U(0xD6E8FEB86659FD93)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the bounds of each text's words; A-Z count as a-z, words end at ASCII white space."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    begins, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    sizes = ends - begins
    at = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(at, sizes)
    powers = np.cumprod(np.full(int(sizes.max()) + 1 if len(sizes) else 1, _ODD))
    values = _BYTES[data[~space]] * powers[inside]
    hashes = mixed(np.add.reduceat(values, at) + sizes.astype(_U)) if len(sizes) else np.empty(0, _U)
    starts = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return hashes, np.searchsorted(begins, starts)


def shingle_sets(texts: Sequence[str], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``n``-word shingles; of fewer words, their sequence as one; of none, none."""
    words, bounds = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - n + 1), _U)
    for k in range(n):
        rolled += mixed(words[k : len(words) - n + 1 + k] + _U(k + 1)) if len(rolled) else rolled
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            sets.append(mixed(np.array([sum(int(mixed(words[a + k : a + k + 1] + _U(k + 1))[0]) for k in range(b - a)) + b - a & 0xFFFFFFFFFFFFFFFF], _U)))
        else:
            sets.append(np.empty(0, _U))
    return sets
