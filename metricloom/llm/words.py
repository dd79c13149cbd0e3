"""Word and window hashes on NumPy arrays, for functions that run in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd base of the Rabin-Karp polynomial modulo 2**64, and the multiplier of the final mix.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
#: A worker remembers the hashes of so many words, then starts over.
REMEMBERED = 500_000


class WordHashes(dict):
    """word bytes -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordPairs(dict):
    """word bytes -> its 128-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two rows of 64-bit halves."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2).T


class Windows:
    """Rabin-Karp hashes of all windows of ``size`` consecutive words.

    With prefix sums S of w[i] * BASE**-i, the polynomial of the window at i is
    (S[i + size] - S[i]) * BASE**(i + size - 1), so one pass serves any window size.
    """

    def __init__(self, size: int):
        self.size = size
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        n = max(n, 2 * len(self.up))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if n < self.size:
            return np.zeros(0, np.uint64)
        if n > len(self.up):
            self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.down[:n], out=sums[1:])
        return mixed((sums[self.size :] - sums[: -self.size]) * self.up[self.size - 1 : n])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))
