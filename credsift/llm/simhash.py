"""SimHash near-duplicates, found by pigeonring filtering.

A text's fingerprint has a bit set where more than half of its word shingles' 64-bit hashes have it. Two fingerprints
link at ``BITS`` (3) or fewer differing bits. Cut into 4 segments on a ring, such a pair has a start from which every
chain of l segments differs in at most 3 l / 4 bits: 0, 1, 2 and 3. So one segment agrees, and the next differs in one
bit at most and has a half that agrees: these 24 bits are the key on which candidates meet. The rest of the chain is
checked before the full distance.

Only distinct fingerprints are compared. Keys that hold more than ``CROWD`` of them (a large group of near copies) are
cut into blocks of bounded size; each pair of blocks is one task's work and gives the links of a spanning forest, not
all pairs: components stay whole, no group is collected and none is cut short.

Edge cases: null and blank texts have fingerprint zero and link like others; fewer words than a shingle count as one
shingle; texts of any length are used whole; repeated rows and ids share their component; null ids are carried, and a
component's id is the smallest that isn't null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, ship_package, staged, text_chunks
from .components import connected_components

SHINGLE, BITS, SEED = 3, 3, 42
CROWD, BLOCK = 64, 2_048
#: Segments of a fingerprint turned so that the chain starts at the top: the second, the third, and the rest.
SECOND, THIRD = 0x0000FFFF00000000, 0x00000000FFFF0000


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    import xxhash

    words = text.lower().split()  # A-Z only, and the ASCII blanks
    n = len(words)
    if not n:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, sig (a hash of the text), fp (the 64 bits as a long)."""
    bounded_batches(documents.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            low = 0
            for keys, buf, offsets in text_chunks(batch):
                raw = buf.tobytes()
                fps = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": keys, "sig": batch.column("sig").slice(low, len(fps)), "fp": pa.array(fps, pa.int64())})
                low += len(fps)

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("sig"), text.alias("text")).mapInArrow(run, "doc_id long, sig long, fp long")


def _chain(x):
    """The pigeonring checks on the differing bits of two turned fingerprints whose first segments agree."""
    return (F.bit_count(x.bitwiseAND(F.lit(SECOND))) <= 1) & (F.bit_count(x.bitwiseAND(F.lit(SECOND | THIRD))) <= 2) & (F.bit_count(x) <= BITS)


def forest(turned: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect what linked pairs connect. ``side`` (0 or 1): only pairs across count; None: all pairs."""
    n = len(turned)
    label, out = np.arange(n), []
    second, both = np.uint64(SECOND), np.uint64(SECOND | THIRD)
    for r in range(n - 1):
        x = turned[r] ^ turned[r + 1 :]
        near = np.flatnonzero(np.bitwise_count(x & second) <= 1)
        near = near[np.bitwise_count(x[near] & both) <= 2]
        near = near[np.bitwise_count(x[near]) <= BITS] + r + 1
        if side is not None:
            near = near[side[near] != side[r]]
        near = near[label[near] != label[r]]
        if len(near):
            groups, first = np.unique(label[near], return_index=True)
            out += [(r, int(k)) for k in near[first]]
            label[np.isin(label, groups)] = label[r]
    return out


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that are within ``BITS`` of each other."""
    spark = fps.sparkSession
    rows = []
    for i in range(4):
        fp = F.col("fp")
        turned = fp if i == 0 else F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i))
        for half in (0, 1):
            head = F.shiftrightunsigned(turned, 48)
            part = F.shiftrightunsigned(turned, 40 - 8 * half).bitwiseAND(F.lit(0xFF))
            key = F.lit((2 * i + half) << 24).bitwiseOR(F.shiftleft(head, 8)).bitwiseOR(part)
            rows.append(F.struct(key.alias("key"), turned.alias("turned")))
    keyed = fps.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.key", "k.turned")
    crowded = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "crowded")
    few = keyed.join(crowded, "key", "left_anti")
    a, b = few.alias("a"), few.alias("b")
    some = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _chain(F.col("a.turned").bitwiseXOR(F.col("b.turned")))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = keyed.join(crowded, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp", "turned")
    ship_package(spark)

    def connect(group):
        import pyarrow as pa

        fp = group.column("fp").to_numpy()
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        turned = group.column("turned").to_numpy().astype(np.int64).view(np.uint64)
        side = None if p == q else (group.column("own").to_numpy() == q).astype(np.int8)
        found = np.array(forest(turned, side), np.int64).reshape(-1, 2)
        return pa.table({"a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    dense = many.groupBy("key", "p", "q").applyInArrow(connect, "a long, b long")
    return some.union(dense).distinct()


def _grouped(documents: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sig, fp), and for each fingerprint its component's smallest id and the row that stands for it."""
    marked = staged(fingerprints(documents, shingle), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(row).alias("best")), "distinct-fingerprints")
    roots = staged(connected_components(links(distinct.select("fp"))), "roots")
    owner = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", "best", F.coalesce("root", "fp").alias("root"))
    lowest = owner.groupBy("root").agg(F.min("low").alias("component_id"), F.min("best").alias("best"))
    return marked, staged(owner.select("fp", "root").join(lowest, "root").select("fp", "component_id", "best"), "components")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    marked, component = _grouped(documents, shingle)
    return marked.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
