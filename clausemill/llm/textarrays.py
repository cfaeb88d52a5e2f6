"""Many texts as one flat array of code points, and hashes of any stretch of it."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Stands for a digit in folded text; no character has this code.
DIGIT = 0x10FFFE
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and where each text starts (one entry more than texts)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=ends[1:])
    return flat, ends


@functools.lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@functools.lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Each code point in lower case without accents; 0 for a combining mark, ``DIGIT`` for a digit, a blank for white
    space other than the newline."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch == "\n" or 0xD800 <= c < 0xE000:
            continue
        if ch.isspace():
            out[c] = 32
        elif ch.isdecimal():
            out[c] = DIGIT
        elif unicodedata.combining(ch):
            out[c] = 0
        elif c < 128:
            out[c] = ord(ch.lower())
        else:
            bare = [x for x in unicodedata.normalize("NFD", ch.lower()) if not unicodedata.combining(x)]
            if len(bare) == 1:
                out[c] = ord(bare[0])
    return out


@functools.lru_cache(maxsize=4)
def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, n of each."""
    base = int(_BASES[which])
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, in order."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Hasher:
    """Hash of any stretch [start, end) of a flat array, equal for equal content wherever it stands."""

    def __init__(self, flat: np.ndarray, which: int = 0):
        size = 1 << max(16, int(len(flat) + 1).bit_length())
        power, self.inverse = powers(which, size)
        self.sums = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.inverse[start]
        return mix(h)

    def windows(self, width: int) -> np.ndarray:
        """Hash of the window of this width at each place where one fits."""
        h = self.sums[width:] - self.sums[:-width]
        h *= self.inverse[: len(h)]
        return mix(h)


def firsts(mask: np.ndarray) -> np.ndarray:
    """Where a run of true values begins."""
    out = mask.copy()
    out[1:] &= ~mask[:-1]
    return out
