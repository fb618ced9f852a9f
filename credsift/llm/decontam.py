"""Benchmark decontamination by CGK random-walk embedding and bit-sampling LSH over item-sized windows.

Texts and items are sequences of lower-cased words. A text leaks an item of n words if some run of its words is within
``EDITS`` * n word edits of it. Candidates come from windows of exactly n words: the random walk of Chakraborty,
Goldenberg and Koucky writes each symbol, moving on or staying by a hash of step and symbol, so that few edits leave
most of the output alike; ``REPEATS`` walks are sampled at ``SAMPLES`` steps each, and windows that agree with an item on
all samples of a walk are verified by an exact edit distance with free ends. Windows that cannot be within the bound (each
edit breaks three of an item's word triples at most, so the window must hold the others) are passed over before the walk;
that filter loses nothing. A text shorter than an item has no window of its size; it is compared directly with the items of
which it holds enough triples.

The items are broadcast in parts of at most ``PART_BYTES``; a larger benchmark takes more passes over the texts.

Items of fewer than ``MIN_WORDS`` words are too short for edits to mean anything: they leak where all of their words stand in
a text in their order, next to each other.

Words are runs of letters, digits and any character beyond ASCII; a character of Chinese, Japanese, Thai, Lao, Khmer or Burmese is a
word by itself, as these scripts put no spaces between words.

Edge cases: null texts have no words; items without a word (or null) leak nowhere; repeated items and repeated rows each give their own rows; very long texts are searched whole; an
empty table of either kind gives an empty result (and ``decontaminate`` then keeps all); other columns are ignored, or kept
by ``decontaminate``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, free_name, text_chunks
from ._winnow import _mix, range_hashes

EDITS, MIN_WORDS = 0.2, 8
REPEATS, SAMPLES, SEED = 24, 2, 11
PART_BYTES = 32 << 20
SCAN_BYTES = 1 << 20  # of text searched at a time
BLOCK = 18  # words of the first, coarse check
PAD = np.uint64(0x5DEECE66D)

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and the number of the word at which each text starts."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[buf]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    starts[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    # characters of scripts without spaces are words by themselves
    alone = (buf >= 0xE3) & (buf <= 0xE9)
    alone[:-1] |= ((buf[:-1] == 0xE0) & (buf[1:] >= 0xB8) & (buf[1:] <= 0xBB)) | ((buf[:-1] == 0xE1) & (((buf[1:] >= 0x80) & (buf[1:] <= 0x82)) | ((buf[1:] >= 0x9E) & (buf[1:] <= 0x9F))))
    at = np.flatnonzero(alone)
    starts[at] = ends[np.minimum(at + 2, len(buf) - 1)] = True
    before, after = at[at > 0] - 1, at[at + 3 < len(buf)] + 3
    ends[before] |= inside[before]
    starts[after] |= inside[after]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return range_hashes(buf, a, b), np.searchsorted(a, offsets)


def _triples(words: np.ndarray) -> np.ndarray:
    pair = _mix(words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1])
    return _mix(pair * np.uint64(0x9E3779B97F4A7C15) + words[2:])


def edits_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The fewest word edits between ``item`` and any run of ``text``, and the end of the first such run."""
    m = len(text)
    row, steps = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, w in enumerate(item, 1):
        new = np.empty(m + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """Items with their set of word triples and the sampled walks of each."""

    def __init__(self, ids: list, texts: list[bytes], edits: float = EDITS, repeats: int = REPEATS, samples: int = SAMPLES):
        self.ids, self.edits, self.words = [], edits, []
        self.repeats, self.samples = repeats, samples
        rng = np.random.default_rng(SEED)
        self.seeds = rng.integers(1, 1 << 63, (repeats, 1), dtype=np.uint64)
        self.places = np.sort(rng.random((repeats, samples)), 1)
        for i, t in zip(ids, texts):
            w, _ = words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            if len(w) >= MIN_WORDS:
                self.ids.append(i)
                self.words.append(w)
        self.short: dict[int, dict[bytes, list]] = {}  # by number of words, then by these: the ids
        for i, t in zip(ids, texts):
            w, _ = words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            if 0 < len(w) < MIN_WORDS:
                self.short.setdefault(len(w), {}).setdefault(w.tobytes(), []).append(i)
        self.size = np.array([len(w) for w in self.words], np.int64)
        every = [_triples(w) for w in self.words]
        self.every = every
        flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
        owner = np.stack([flat, np.repeat(self.size, [len(t) for t in every]).astype(np.uint64)], 1)
        owner = np.unique(owner, axis=0)  # a triple and the sizes of the items that hold it
        self.triples, begin = np.unique(owner[:, 0], return_index=True)
        self.sizes_of, self.sizes_at = owner[:, 1].astype(np.int64), np.append(begin, len(owner))
        bits = max(16, int(len(self.triples) * 64).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.triples >> self.shift] = True
        self.sizes = np.unique(self.size)
        self.limit = {int(n): int(edits * n) for n in self.sizes}
        self.need = {n: n - 2 - 3 * k for n, k in self.limit.items()}
        self.least = min((max(1, -(-self.need[n] // -(-(n + k) // BLOCK))) for n, k in self.limit.items()), default=1)
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        keys = self.walks(flat, np.cumsum(self.size) - self.size, self.size)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], (order % max(1, len(self.words)))

    def walks(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys (a row for each walk) of the windows words[start : start + size]."""
        m = len(start)
        at = np.zeros((self.repeats, m), np.int64)
        keys = np.tile(size.astype(np.uint64), (self.repeats, 1)) * np.uint64(0x9E3779B97F4A7C15) + self.seeds
        if not m:
            return keys
        wanted = np.floor(self.places[:, :, None] * (2 * size)).astype(np.int64)  # walk, sample, window
        for step in range(int(wanted.max()) + 1):
            inside = at < size
            symbol = np.where(inside, words[start + np.minimum(at, size - 1)], PAD)
            for k in range(self.samples):
                hit = wanted[:, k] == step
                if hit.any():
                    keys = np.where(hit, _mix(keys * np.uint64(0x100000001B3) + symbol), keys)
            coin = _mix(symbol + self.seeds * np.uint64(2 * step + 1)) >> np.uint64(63)
            at += coin.astype(np.int64)
        return keys

    def leaks(self, words: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(text, item id, edits, words of the item, end word) of all leaks of texts, given all their words and where each starts."""
        out = [(t, self.ids[item], edits, int(self.size[item]), end) for t, item, edits, end in self.find(words, first)]
        for n, known in self.short.items():
            if len(words) < n:
                continue
            heads = np.unique(np.array([np.frombuffer(w, np.uint64)[0] for w in known]))
            places = np.flatnonzero(np.isin(words[: len(words) - n + 1], heads))
            text = np.searchsorted(first, places, "right") - 1
            inside = places + n <= first[text + 1]
            seen = set()
            for place, t in zip(places[inside].tolist(), text[inside].tolist()):
                own = words[place : place + n].tobytes()
                if own in known and (t, own) not in seen:
                    seen.add((t, own))
                    out += [(t, i, 0, n, place + n - int(first[t])) for i in known[own]]
        return out

    def find(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, end word) of the leaks of texts, given all their words and where each starts."""
        if not self.words or len(words) < 3:
            return []
        triple = _triples(words)
        maybe = np.flatnonzero(self.bitmap[triple >> self.shift])
        if not len(maybe):
            return []
        near = np.searchsorted(self.triples, triple[maybe])
        maybe = maybe[self.triples[np.minimum(near, len(self.triples) - 1)] == triple[maybe]]
        ahead = np.searchsorted(maybe, maybe + BLOCK)
        dense = maybe[ahead - np.arange(len(maybe)) >= self.least]
        if not len(dense):
            return []
        texts = np.unique(np.searchsorted(first, dense, "right") - 1)
        starts, sizes = [], []
        found: dict[tuple[int, int], list[int]] = {}
        which = np.searchsorted(self.triples, triple[maybe])
        for t in texts.tolist():
            a, b = int(first[t]), int(first[t + 1])
            lo, hi = np.searchsorted(maybe, [a, b - 2]) if b - a > 2 else (0, 0)
            at, row = maybe[lo:hi], which[lo:hi]
            count = self.sizes_at[row + 1] - self.sizes_at[row]
            place = np.repeat(at, count)
            size = self.sizes_of[np.repeat(self.sizes_at[row] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            for n in np.unique(size).tolist():
                k, own = self.limit[n], place[size == n]
                if b - a < n - k or len(own) < self.need[n]:
                    continue
                if b - a < n:
                    for item in np.flatnonzero(self.size == n).tolist():
                        if np.isin(self.every[item], triple[a : b - 2]).sum() >= self.need[n]:
                            found[t, item] = [a]
                    continue
                # Windows that reach a triple of an item of this size, and enough of them.
                low = np.unique((own[:, None] + np.arange(-(n + k), k + 1)).ravel()) if len(own) * (n + k) < 4 * (b - a) else np.arange(a, b)
                low = np.unique(np.clip(low, a, max(a, b - n)))
                got = np.searchsorted(own, np.minimum(low + n + k, b)) - np.searchsorted(own, np.maximum(low - k, a))
                low = low[got >= self.need[n]]
                starts.append(low)
                sizes.append(np.minimum(n, b - low))
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        for chunk in range(0, len(start), 20_000):
            s, z = start[chunk : chunk + 20_000], size[chunk : chunk + 20_000]
            keys = self.walks(words, s, z).ravel()
            lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            some = np.flatnonzero(hi > lo)
            for j in some.tolist():
                w = int(s[j % len(s)])
                for item in set(self.owner[lo[j] : hi[j]].tolist()):
                    found.setdefault((int(np.searchsorted(first, w, "right")) - 1, item), []).append(w)
        out = []
        for (t, item), where in sorted(found.items()):
            n = int(self.size[item])
            k, a, b = self.limit[n], int(first[t]), int(first[t + 1])
            best = None
            where = sorted(set(where))
            low = 0
            while low < len(where):  # windows that overlap are verified together
                high = low
                while high + 1 < len(where) and where[high + 1] <= where[high] + n:
                    high += 1
                begin = max(a, where[low] - k)
                edits, end = edits_within(self.words[item], words[begin : min(b, where[high] + n + k)])
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, begin + end - a)
                low = high + 1
            if best is not None:
                out.append((t, item, *best))
        return out


def item_parts(benchmark: DataFrame):
    """The items in parts of bounded size, as (ids, texts)."""
    rows = benchmark.filter("text is not null").select("item_id", F.lower(F.col("text").cast("string")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-size // PART_BYTES))
    for p in range(parts):
        got = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in got], [r["text"].encode() for r in got]


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, n_words (of the item), end_word: a row for each text and item that it leaks."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for ids, texts in item_parts(benchmark):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches, sent=sent):
            import pyarrow as pa

            items = Items(*sent.value)
            for batch in batches:
                for keys, buf, offsets in text_chunks(batch, limit=SCAN_BYTES):
                    got = items.leaks(*words_of(buf, offsets))
                    if got:
                        yield pa.RecordBatch.from_pydict({"doc_id": keys.take(pa.array([g[0] for g in got])), "item_id": pa.array([g[1] for g in got], pa.int64()), "edits": pa.array([g[2] for g in got], pa.int32()), "n_words": pa.array([g[3] for g in got], pa.int32()), "end_word": pa.array([g[4] for g in got], pa.int64())})

        found = rows.mapInArrow(run, "doc_id long, item_id long, edits int, n_words int, end_word long")
        out = found if out is None else out.union(found)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that leak no item, all columns as they were."""
    spark = documents.sparkSession
    bounded_batches(spark)
    schema, lower = documents.schema, free_name(documents, "_lower")
    for ids, texts in item_parts(benchmark):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches, sent=sent):
            import pyarrow as pa

            items = Items(*sent.value)
            for batch in batches:
                clean, low = np.ones(batch.num_rows, bool), 0
                for keys, buf, offsets in text_chunks(batch, lower, lower, SCAN_BYTES):
                    for g in items.leaks(*words_of(buf, offsets)):
                        clean[low + g[0]] = False
                    low += len(offsets) - 1
                yield batch.filter(pa.array(clean)).select([n for n in batch.schema.names if n != lower])

        documents = documents.withColumn(lower, F.lower(F.col("text").cast("string"))).mapInArrow(run, schema)
    return documents
