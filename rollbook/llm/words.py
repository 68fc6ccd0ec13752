"""Hashes of words and shingles of whole texts, by arrays over a block of texts at a time."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
BLOCK = 1 << 18  # bytes of text in one block, whose arrays take some fifty times as many


def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixing of each element (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD^i and _ODD^-i modulo 2^64 for i below n."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words:
    """Words of a block of texts: hash, start and end of each, and the first word of each text.

    Words are runs of bytes other than space and tab to carriage return; A-Z
    count as a-z. ``first`` has one more entry than there are texts.
    """

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        if len(Words._up) < len(data) + 1:
            Words._up, Words._down = _powers(max(BLOCK + 4096, len(data) + 1))
        lower = data.astype(np.uint64)
        lower[(data >= 65) & (data <= 90)] += np.uint64(32)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((lower + np.uint64(1)) * Words._up[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * Words._down[self.starts])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.data = data


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words (of all its words if fewer), and where each text's begin; a wordless text has none."""
    h, first = words.hashes, words.first
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    begins = np.concatenate([[0], np.cumsum(count)])
    which = np.repeat(np.arange(len(n)), count)
    at = np.arange(begins[-1]) - begins[which] + first[which]
    out = np.zeros(begins[-1], np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    span = np.minimum(n, width)[which]
    for i in range(width):
        out = mix(out * _ODD + np.where(i < span, padded[at + i], np.uint64(0)) + np.uint64(i + 1))
    return out, begins


def distinct(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted, without repeats."""
    which = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((hashes, which))
    h, w = hashes[order], which[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return h[keep], np.searchsorted(w[keep], np.arange(len(begins)))


def least_of_each(hashes: np.ndarray, begins: np.ndarray, coordinates: int, seed: int = 0) -> np.ndarray:
    """MinHash signatures: for each coordinate, the least of a remixed hash over each text's shingles (all ones for none)."""
    out = np.full((len(begins) - 1, coordinates), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.flatnonzero(np.diff(begins) > 0)
    if len(full):
        for c in range(coordinates):
            salt = mix(np.array([c + 1 + 1000 * seed], np.uint64) * _ODD)[0]
            odd = mix(np.array([salt], np.uint64))[0] | np.uint64(1)
            x = (hashes ^ salt) * odd
            x ^= x >> np.uint64(32)
            x *= _MIX1
            out[full, c] = np.minimum.reduceat(x, begins[full])
    return out


def blocks(texts: list[str | None], most: int = BLOCK):
    """(first, encoded texts) for runs of texts of about ``most`` bytes; a longer text is a block of its own."""
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if held and size + len(b) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


class Runs:
    """Hashes of runs of words from the hashes of single ones: as a rolling hash, so any run takes one step."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        if len(Runs._up) < self.n + 1:
            Runs._up, Runs._down = _powers(max(BLOCK // 4, self.n + 1))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * Runs._up[: self.n], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` words."""
        m = max(0, self.n - width + 1)
        return mix((self.sums[width : width + m] - self.sums[:m]) * Runs._down[:m] + np.uint64(width))

    def spans(self, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each run from ``firsts`` to ``ends``."""
        return mix((self.sums[ends] - self.sums[firsts]) * Runs._down[firsts] + (ends - firsts).astype(np.uint64))
