"""Token ids on disk: concatenated id arrays whose document boundaries are Elias-Fano coded.

A store is a Parquet folder of blocks. Each block is the image of one small file: a header, the Elias-Fano code of the
document ids (ascending), the Elias-Fano code of the document boundaries, and the ids as little-endian integers of the
narrowest width that holds the vocabulary. Boundaries of n documents over u ids take about n * (2 + log2(u / n)) bits
instead of 64 n; a select directory answers "where does document k start" without decoding the rest.

Edge cases: a null or empty text holds only the end id; null document ids come first and are counted in the header;
repeated document ids are stored once for each row, in any order among themselves; an empty table makes an empty store;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bpe_core import SLICE, BatchEncoder, byte_alphabet
from ._common import bounded_batches, shared_dir, text_chunks

MAGIC = b"EFTB"
SAMPLE = 64  # a select directory entry for each so many set bits


class EliasFano:
    """A non-decreasing sequence of n integers below u: low bits verbatim, high bits in unary, a sampled select directory."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.directory = n, universe, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        high_at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high_at[-1]) + 1 if n else 0, np.uint8)
        bits[high_at] = 1
        low = np.zeros(0, np.uint8)
        if low_bits and n:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), high_at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(x).tobytes() for x in (self.low, self.high, self.directory)]
        return struct.pack("<QQIIII", self.n, self.universe, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, data: memoryview) -> tuple["EliasFano", int]:
        n, universe, low_bits, a, b, c = struct.unpack_from("<QQIIII", data)
        at = struct.calcsize("<QQIIII")
        low, high = (np.frombuffer(data, np.uint8, size, at + skip) for size, skip in ((a, 0), (b, a)))
        return cls(n, universe, low_bits, low, high, np.frombuffer(data, "<u4", c // 4, at + a + b)), at + a + b + c

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (window >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: start at the sampled set bit and count on from there."""
        at = int(self.directory[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = int(self.high[byte]) & (0xFF << (at % 8)) & 0xFF
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return ((position - i) << self.low_bits) | (self._low(i) if self.low_bits else 0)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


def pack_block(doc_ids: list, bounds: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One block. ``doc_ids`` ascend, nulls first; ``bounds`` has an entry more than there are documents."""
    given = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(given[0]) if len(given) else 0
    keys = EliasFano.of((given - base).astype(np.uint64)).to_bytes()
    ends = EliasFano.of(bounds).to_bytes()
    body = ids.astype(f"<u{width}").tobytes()
    head = MAGIC + struct.pack("<IQQqQI", width, len(doc_ids), len(doc_ids) - len(given), base, len(ids), zlib.crc32(body))
    return head + keys + ends + body


class Block:
    """A block read back: document ids, boundaries and ids without copying the ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        self.width, self.n_docs, self.n_null, base, self.n_ids, crc = struct.unpack_from("<IQQqQI", data, 4)
        view = memoryview(data)[4 + struct.calcsize("<IQQqQI") :]
        keys, used = EliasFano.read(view)
        self.bounds, more = EliasFano.read(view[used:])
        body = view[used + more :]
        if zlib.crc32(body) != crc:
            raise ValueError("a token block is damaged")
        self.doc_ids = [None] * self.n_null + (keys.all().astype(np.int64) + base).tolist()
        self.ids = np.frombuffer(body, f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.bounds.select(k) : self.bounds.select(k + 1)]


@cache
def _library(path: str) -> tuple[BatchEncoder, int]:
    """An encoder for a worker's life, and the size of the vocabulary. It resolves pieces with the tokenizers library's model (byte-level: a printable stand-in for each byte)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
    model, stand_in = tokenizer.model, {b: c for c, b in byte_alphabet().items()}

    def resolve(pieces: list[bytes]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(p.decode("latin-1").translate(stand_in))] for p in pieces]

    return BatchEncoder(resolve, special), tokenizer.get_vocab_size()


def write_store(documents: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = 1 << 20) -> str:
    """Encode every text, append ``end_id``, and write blocks of about ``block_ids`` ids in ascending ``doc_id`` order; returns the folder."""
    spark = documents.sparkSession
    bounded_batches(spark)

    def encode(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, size = _library(tokenizer_path)
        width, part = 2 if max(size, end_id + 1) <= 1 << 16 else 4, TaskContext.get().partitionId()
        docs, sizes, held, count, seq = [], [], [], 0, 0

        def block():
            ids = np.concatenate(held) if held else np.zeros(0, np.int32)
            bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(docs)], "n_ids": [len(ids)], "block": [pack_block(docs, bounds, ids, width)]}, schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for keys, buf, offsets in text_chunks(batch, limit=SLICE):
                ids, at = encoder(buf, offsets)
                n = len(at) - 1
                grown = np.empty(len(ids) + n, np.int32)
                ends = at[1:] + np.arange(n)
                mask = np.ones(len(grown), bool)
                mask[ends] = False
                grown[mask], grown[ends] = ids, end_id
                docs += keys.to_pylist()
                sizes += (np.diff(at) + 1).tolist()
                held.append(grown)
                count += len(grown)
                if count >= block_ids:
                    yield block()
                    docs, sizes, held, count, seq = [], [], [], 0, seq + 1
        if docs:
            yield block()

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    ordered.mapInArrow(encode, "part int, seq int, n_docs long, n_ids long, block binary").write.option("compression", "zstd").parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Offsets of blocks are running sums, per part over its blocks and over the parts' totals (one number for each write task).
    """
    blocks = spark.read.schema("part int, seq int, n_docs long, n_ids long, block binary").parquet(path)
    sizes = blocks.select("part", "seq", "n_ids")
    totals, base = {}, 0
    for part, n in sorted(tuple(r) for r in sizes.groupBy("part").agg(F.sum("n_ids")).collect()):
        totals[part], base = base, base + n
    parts = spark.createDataFrame(sorted(totals.items()), "part int, part_start long")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("before")).alias("block_start"))

    def documents(batches):
        import pyarrow as pa

        for batch in batches:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "block"))):
                block = Block(data)
                n = block.n_docs
                at, size, crc = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                end = block.bounds.select(0)
                for k in range(n):
                    at[k], end = end, block.bounds.select(k + 1)
                    size[k], crc[k] = end - at[k], zlib.crc32(block.ids[at[k] : end].astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(block.doc_ids, pa.int64()), "at": pa.array(at), "n_tokens": pa.array(size), "ids_crc32": pa.array(crc)})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    rows = blocks.mapInArrow(documents, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
