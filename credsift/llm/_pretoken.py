"""Vectorised byte-level pre-tokenisation: where the pieces start that byte-pair merges never cross.

The pieces are those of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: runs of letters, digits, other signs and
white space, a single blank going to the run after it, and English contractions on their own.
"""

from __future__ import annotations

from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    """Class of each code point, once a process. Where two Unicode versions disagree, the tokenizers library decides."""
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    out = np.zeros(0x110000, np.uint8)
    library = ByteLevel(add_prefix_space=False)
    for low in range(0, 0x110000, 1 << 13):
        points = [p for p in range(low, low + (1 << 13)) if not 0xD800 <= p < 0xE000]
        every = "".join(map(chr, points))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            out[[ord(c) for c in regex.findall(pattern, every)]] = kind
        older = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in every], np.uint8)
        now = out[points]
        for i in np.flatnonzero((now != older) & (now != SPACE)):
            joins = [len(library.pre_tokenize_str(x + every[i])) == 1 for x in "a1"]
            out[points[i]] = LETTER if joins[0] else NUMBER if joins[1] else OTHER
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the characters of valid UTF-8, and their code points."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = buf[lead].astype(np.int32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        at, first = lead[wide], points[wide]
        follow = [buf[np.minimum(at + k, len(buf) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        two = ((first & 0x1F) << 6) | follow[0]
        three = ((first & 0x0F) << 12) | (follow[0] << 6) | follow[1]
        four = ((first & 0x07) << 18) | (follow[0] << 12) | (follow[1] << 6) | follow[2]
        points[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))
    return lead, points


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which a piece starts, over texts laid end to end; ``offsets`` are the texts' bounds (n + 1 of them)."""
    if len(buf) == 0:
        return np.zeros(0, np.int64)
    lead, points = code_points(buf)
    kind = _classes()[points]
    n = len(lead)
    first = np.zeros(n + 1, bool)  # a text starts at this character
    first[np.searchsorted(lead, offsets)] = True
    first[n] = True
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    gap = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])  # last of a run of white space before something else
    start[gap] = True
    start[gap[points[gap] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        far = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~first[quote + 2 - (quote + 2 > n)], points[far], 0)
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after[kind[after] == LETTER]] = True
    return lead[start]
