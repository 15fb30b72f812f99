"""Words of texts as 64-bit hashes, for many texts at once.

Words are runs of bytes other than U+0020 and U+0009 to U+000D, which is how
``bytes.split()`` divides a text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


def hashed_split(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text's words begin and end."""
    edge = np.cumsum([0, *map(len, split)])
    words = np.empty(edge[-1], dtype=object)
    words[:] = [w for s in split for w in s]
    if not len(words):
        return np.array([], dtype=np.uint64), edge
    code, distinct = pd.factorize(words)
    return pd.util.hash_array(distinct, categorize=False)[code], edge


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_split([t.split() for t in texts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output looks random."""
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _MORE
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; they ignore where texts begin and end.

    Runs of twice a length are made from two runs of that length, so that the work grows
    with the logarithm of the size.
    """
    if len(words) < size:
        return np.array([], dtype=np.uint64)
    out: np.ndarray | None = None
    done, power, width = 0, mixed(words), 1
    while True:
        if size & width:
            if out is None:
                out, done = power, width
            else:
                n = len(words) - done - width + 1
                out = mixed(out[:n] * _MORE + power[done : done + n] * _ODD)
                done += width
        width *= 2
        if width > size:
            return out[: len(words) - size + 1]
        n = len(words) - width + 1
        half = width // 2
        power = mixed(power[:n] * _ODD + (power[half : half + n] ^ _MORE))


def lowest_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
