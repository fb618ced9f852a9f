"""Content-chosen anchors: any two equal strings of ``length`` bytes hold an equal anchor at the same place.

Every window of ``length`` bytes chooses the one of its ``gram``-byte strings with the least hash, the leftmost of equals,
so equal windows choose alike whatever surrounds them.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


#: Bytes hashed at a time; the tables of powers have this size whatever the texts' lengths.
BLOCK = 1 << 16


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up = np.full(BLOCK, BASE, np.uint64)
        down = np.full(BLOCK, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sums(piece: np.ndarray) -> np.ndarray:
    out = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers()[0][: len(piece)], out=out[1:])
    return out


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on."""
    out = np.zeros(max(0, len(buf) - gram + 1), np.uint64)
    step = BLOCK - gram + 1
    for at in range(0, len(out), step):
        sums = _sums(buf[at : at + BLOCK])
        n = len(sums) - gram
        out[at : at + n] = _mix((sums[gram:] - sums[:-gram]) * _powers()[1][:n])
    return out


def range_hashes(buf: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; neither ends of ranges may descend. A range beyond ``BLOCK`` bytes is hashed on its own."""
    import xxhash

    out, i = np.zeros(len(low), np.uint64), 0
    while i < len(low):
        base = int(low[i])
        j = int(np.searchsorted(high, base + BLOCK, "right"))
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(buf[base : int(high[i])].tobytes(), 5)
            i += 1
            continue
        j = min(j, i + int(np.searchsorted(low[i:j], base + BLOCK - 1, "right")))
        sums = _sums(buf[base : int(high[j - 1])])
        a, b = low[i:j] - base, high[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * _powers()[1][a]
        i = j
    return _mix(out)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys (running minima of blocks from both sides)."""
    n = len(keys)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    block = padded.reshape(-1, width)
    left = np.minimum.accumulate(block, 1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts laid end to end; windows lie within one text."""
    n, width = len(buf), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(buf, gram)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(keys, width) & np.uint64(0xFFFFFFFF)
    own = np.zeros(n + 1, np.int32)  # windows that start in a text and end beyond it don't count
    inside = np.diff(offsets) >= length
    np.add.at(own, offsets[:-1][inside], 1)
    np.add.at(own, offsets[1:][inside] - length + 1, -1)
    valid = np.cumsum(own[: len(least)]) > 0
    chosen = least[valid].astype(np.int64)
    chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])] if len(chosen) else chosen
    return chosen, hashes[chosen]
