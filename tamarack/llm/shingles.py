"""Words and word windows as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII white space; ``lower`` folds A-Z alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them, another one for each salt."""
    x = x + np.uint64((salt * BASE + 0x632BE59BD9B4E019) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; as many as there are words less width - 1, at least none."""
    if len(h) < width:
        return np.empty(0, dtype=np.uint64)
    done, done_len, part, part_len, left = None, 0, h, 1, width
    while left:  # windows of doubling length, put together as the bits of the width say
        if left & 1:
            if done is None:
                done, done_len = part, part_len
            else:
                n = len(h) - done_len - part_len + 1
                done = done[:n] * np.uint64(pow(BASE, part_len, 1 << 64)) + part[done_len : done_len + n]
                done_len += part_len
        left >>= 1
        if left:
            n = len(h) - 2 * part_len + 1
            part = part[:n] * np.uint64(pow(BASE, part_len, 1 << 64)) + part[part_len : part_len + n]
            part_len *= 2
    return mix(done)


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct windows; of fewer words the whole sequence as one, of none nothing."""
    if len(h) >= width:
        return np.unique(windows(h, width))
    return mix(windows(h, len(h)), len(h)) if len(h) else np.empty(0, dtype=np.uint64)
