"""Words and rolling hashes of one text, in numpy. Words are separated by ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z (and nothing else) in lower case."""
    return utf8(text).translate(_LOWER)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


class Powers:
    """Powers of the base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(1024, 2 * n)
            up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
            up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
            self.up, self.down, self.n = up, down, size
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    up, _ = POWERS.upto(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return total


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, equal wherever the words are equal."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = POWERS.upto(n)
    return mixed((sums[width:] - sums[:-width]) * down)
