"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words are counted over all texts; the most frequent ``LEXICON_WORDS`` are compiled into a minimal automaton whose
states share suffixes. Each edge carries the number of words that sort before the ones reached through it, so the sum
along a path numbers the word, and that number finds its ids. The automaton is one small file image (bounded by the
number of words), memory-mapped by every worker; words outside it are merged exactly. Decoding joins the bytes of ids.

Edge cases: null text counts as empty; an empty text has no ids and decodes to the empty text; words of any length are
merged exactly (a heap of pairs); special tokens in a text keep their own id; repeated rows give repeated results; other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe_core import SLICE, BatchEncoder, merge, pieces_of, vocabulary
from ._common import bounded_batches, staged, text_chunks

LEXICON_WORDS = 1 << 15
COUNT_BYTES = 12 << 20  # of words counted in a worker before they go to Spark, about, with 96 for each besides its own


def word_counts(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """word (binary), n: over all texts. Workers count in bounded tables; Spark sums the rest by word."""
    bounded_batches(documents.sparkSession)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        special = tuple(vocabulary(tokenizer_path)[2])
        seen: Counter = Counter()

        def told():
            out = pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        held = 0
        for batch in batches:
            for _, buf, offsets in text_chunks(batch, limit=SLICE):
                before = len(seen)
                pieces = pieces_of(buf, offsets, special)[0]
                seen.update(pieces)
                held += (len(seen) - before) * (96 + len(buf) // max(1, len(pieces)))
                if held > COUNT_BYTES:
                    yield told()
                    held = 0
        if seen:
            yield told()

    rows = documents.select(F.lit(0).alias("doc_id"), F.col("text").cast("string")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(words: list[bytes], tokenizer_path: str) -> bytes:
    """The file image: sorted edges (state * 256 + byte -> state, words before), final states, and the ids of each word."""
    words = sorted(set(words))
    # States are built along the sorted words; a finished branch is replaced by an equal one seen before.
    children: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], tuple(children[state].items()))
            children[path[-1]][last[len(path) - 1]] = register.setdefault(key, state)

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        settle(shared)
        for b in word[shared:]:
            children.append({})
            final.append(False)
            children[path[-1]][b] = len(children) - 1
            path.append(len(children) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for to in children[stack.pop()].values():
            if to not in number:
                number[to] = len(order)
                order.append(to)
                stack.append(to)
    below: dict[int, int] = {}

    def total(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            open_ = [c for c in children[s].values() if c not in below]
            if open_:
                todo += open_
            else:
                below[s] = final[s] + sum(below[c] for c in children[s].values())
                todo.pop()
        return below[state]

    total(0)
    edges = []
    for s in order:
        before = int(final[s])
        for b, to in sorted(children[s].items()):
            edges.append((number[s] * 256 + b, number[to], before))
            before += below[to]
    edges.sort()
    ids = [merge(w, tokenizer_path) for w in words]
    sizes = np.cumsum([0, *map(len, ids)])
    parts = [np.array([e[0] for e in edges], "<i8"), np.array([e[1] for e in edges], "<i4"), np.array([e[2] for e in edges], "<i4"), np.array([final[s] for s in order], "u1"), sizes.astype("<i4"), np.array([x for row in ids for x in row], "<i4")]
    raw = [p.tobytes() for p in parts]
    return struct.pack("<6q", *map(len, raw)) + b"".join(raw)


class Lexicon:
    """A compiled lexicon, memory-mapped; looks up many words at once by stepping all of them a byte at a time."""

    def __init__(self, image: bytes):
        file = tempfile.TemporaryFile()  # unnamed: gone with the worker
        file.write(image)
        file.flush()
        at, sizes = 48, struct.unpack_from("<6q", image)
        arrays = []
        for size, kind in zip(sizes, ("<i8", "<i4", "<i4", "u1", "<i4", "<i4")):
            n = size // np.dtype(kind).itemsize
            arrays.append(np.frombuffer(np.memmap(file, np.uint8, "r", at, size), kind) if n else np.zeros(0, kind))
            at += size
        self.key, self.to, self.skip, self.final, self.start, self.ids = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it isn't in the lexicon."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not len(self.key) or not n:
            return out
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(size > 0)
        state, rank, step = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            want = state * 256 + buf[begin[live] + step]
            e = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[e] == want
            live, e = live[ok], e[ok]
            state, rank, step = self.to[e].astype(np.int64), rank[ok] + self.skip[e], step + 1
            done = size[live] == step
            hit = done & (self.final[state] == 1)
            out[live[hit]] = rank[hit]
            live, state, rank = live[~done], state[~done], rank[~done]
        return out

    def resolver(self, tokenizer_path: str):
        def resolve(words: list[bytes]) -> list[list[int]]:
            at = self.find(words)
            return [self.ids[self.start[k] : self.start[k + 1]].tolist() if k >= 0 else merge(w, tokenizer_path) for w, k in zip(words, at.tolist())]

        return resolve


def build_lexicon(documents: DataFrame, tokenizer_path: str, words: int = LEXICON_WORDS) -> bytes:
    """The image for the most frequent words of all texts, ``words`` of them at most.

    A histogram of the counts (eight bins to a doubling) gives the lowest count that keeps within the bound, so the
    driver gets the chosen words only.
    """
    special = vocabulary(tokenizer_path)[2]
    counts = staged(word_counts(documents, tokenizer_path).filter(F.octet_length("word") <= 64), "words")
    level = F.floor(8 * F.log2("n")).cast("int")
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += r["n"]
        if total > words:
            break
        least = r["level"]
    top = counts.filter(level >= least).select("word").collect() if least is not None else []
    return compile_lexicon([bytes(r["word"]) for r in top if bytes(r["word"]) not in special], tokenizer_path)


def encode_decode(documents: DataFrame, tokenizer_path: str, with_ids: bool = False, with_text: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also the ids, with ``with_text`` the decoded text."""
    spark = documents.sparkSession
    image = spark.sparkContext.broadcast(build_lexicon(documents, tokenizer_path, lexicon_words))
    bounded_batches(spark)

    def run(batches):
        import pyarrow as pa

        pieces, _, special = vocabulary(tokenizer_path)
        decimal = [str(i) for i in range(len(pieces))]
        encoder = BatchEncoder(Lexicon(image.value).resolver(tokenizer_path), special)
        for batch in batches:
            for keys, buf, offsets in text_chunks(batch, limit=SLICE):
                ids, at = encoder(buf, offsets)
                bounds = at.tolist()
                rows = {"doc_id": keys, "n_tokens": pa.array(np.diff(at)), "ids_sha256": [], "decoded_sha256": []}
                texts = []
                for a, b in zip(bounds, bounds[1:]):
                    own = ids[a:b].tolist()
                    text = b"".join(map(pieces.__getitem__, own)).decode("utf-8", "replace")
                    rows["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    if with_text:
                        texts.append(text)
                if with_ids:
                    rows["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                if with_text:
                    rows["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(rows)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
