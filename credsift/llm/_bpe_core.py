"""Byte-pair encoding of whole texts, a batch at a time: pieces are found by array operations, each distinct piece is resolved once.

``resolve`` maps pieces not seen before to their ids; the pool of seen pieces is bounded, so a worker's memory is too.
"""

from __future__ import annotations

import gc
import heapq
import json
from functools import cache
from itertools import chain

import numpy as np

from ._pretoken import piece_starts

POOL_BYTES = 24 << 20  # of pieces seen, counting 96 bytes for each besides its own
SLICE = 1 << 20  # bytes of text encoded at a time, about


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next code from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def vocabulary(path: str) -> tuple[list[bytes], tuple[dict[int, int], list[int]], dict[bytes, int]]:
    """Bytes of each id, the merges ((left << 20) | right -> rank, and the id that each rank makes), and the special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    back = byte_alphabet()
    vocab = model["model"]["vocab"]
    special = {t["content"].encode(): t["id"] for t in model.get("added_tokens", ())}
    pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        pieces[i] = bytes(back[c] for c in token)
    for token, i in special.items():
        pieces[i] = token
    merges, into = {}, []
    for rank, pair in enumerate(model["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[(vocab[left] << 20) | vocab[right]] = rank
        into.append(vocab[left + right])
    return pieces, (merges, into), special


@cache
def _byte_ids(path: str) -> list[int]:
    pieces, _, special = vocabulary(path)
    single = {p[0]: i for i, p in enumerate(pieces) if len(p) == 1 and p not in special}
    return [single[b] for b in range(256)]


def merge(piece: bytes, path: str) -> list[int]:
    """The exact merges of one piece: the lowest rank first, the leftmost of equals."""
    _, (merges, into), _ = vocabulary(path)
    single = _byte_ids(path)
    ids = [single[b] for b in piece]
    if len(ids) > 64:
        return _merge_long(ids, merges, into)
    get, never = merges.get, len(into)
    ranks = [get((a << 20) | b, never) for a, b in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best == never:
            break
        i = ranks.index(best)
        ids[i] = into[best]
        del ids[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get((ids[i - 1] << 20) | ids[i], never)
        if i < len(ranks):
            ranks[i] = get((ids[i] << 20) | ids[i + 1], never)
    return ids


def _merge_long(ids: list[int], merges: dict[int, int], into: list[int]) -> list[int]:
    """The same by a heap of pairs over a linked list, for pieces of any length."""
    n = len(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i] << 20) | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue
        ids[i], ids[j] = into[rank], -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else -1
            if a >= 0 and b >= 0 and (m := merges.get((ids[a] << 20) | ids[b])) is not None:
                heapq.heappush(heap, (m, a, ids[a], ids[b]))
    return [x for x in ids if x >= 0]


def pieces_of(buf: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...] = ()) -> tuple[list[bytes], np.ndarray]:
    """The pieces of texts laid end to end, and the number of the piece at which each text starts (and the total)."""
    raw = buf.tobytes()
    bounds = offsets
    inside = []
    for token in special:
        at = raw.find(token)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, "right"))
            if at + len(token) <= offsets[text]:
                inside.append((at, at + len(token)))
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    if inside:
        bounds = np.union1d(offsets, np.array(inside, np.int64).ravel())
    starts = piece_starts(buf, bounds)
    for low, high in inside:
        starts = starts[(starts <= low) | (starts >= high)]
    first = np.searchsorted(starts, offsets)
    cuts = [*starts.tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])], first


class BatchEncoder:
    """Encodes batches of texts; ``resolve(pieces)`` gives the ids of each of a list of distinct pieces."""

    def __init__(self, resolve, special: dict[bytes, int]):
        self.resolve, self.special = resolve, special
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._add([*self.special], [[i] for i in self.special.values()])

    def _add(self, pieces: list[bytes], ids: list[list[int]]) -> None:
        base = len(self.known)
        self.known.update(zip(pieces, range(base, base + len(pieces))))
        self.held += 96 * len(pieces) + sum(map(len, pieces))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, flat])

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text start (n + 1 bounds)."""
        gc.disable()  # hundreds of thousands of small lists, none in a cycle
        try:
            return self._encode(buf, offsets)
        finally:
            gc.enable()

    def _encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces, first = pieces_of(buf, offsets, tuple(self.special))
        if self.held > POOL_BYTES:
            self._reset()
        found = list(map(self.known.get, pieces))
        if None in found:
            gaps = [i for i, k in enumerate(found) if k is None]
            missing = list(dict.fromkeys(pieces[i] for i in gaps))
            self._add(missing, self.resolve(missing))
            for i in gaps:
                found[i] = self.known[pieces[i]]
        which = np.array(found, np.int64)
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.start[which] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[first]
