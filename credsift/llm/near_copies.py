"""Near copies among documents: texts whose sets of five-word shingles have a Jaccard similarity of ``LEAST`` or more.

Candidates meet on minhashes: ``BANDS`` keys of ``ROWS`` minima each, so that a pair at 0.8 exactly meets on none with a chance
of 3 in 100,000, and a closer pair with less. (SimHash doesn't serve here: such pairs lie up to 11 bits apart, and a segment
of a 64-bit fingerprint then selects next to nothing.) What meets is compared exactly, on whole sets of shingles.

Texts with equal sets are one node. Keys of the same nodes are taken once. The nodes of a key are cut into blocks of about
``BLOCK`` shingles, and each block also gets the key's first node; only if a key of several blocks still has unlinked parts
are its blocks compared in pairs. Each task gives the links of a spanning forest, not all pairs: components stay whole, no
group is collected and none is cut short.

Edge cases: null and blank texts are copies of one another; fewer words than a shingle count as one shingle; texts of any
length are used whole; null ids are carried, and a group keeps its smallest id that isn't null; an empty table gives an
empty result; other columns are kept as they were.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, bounded, bounded_batches, free_name, ship_package, staged, text_chunks
from ._winnow import _mix
from .components import connected_components
from .simhash import shingle_hashes

SHINGLE, LEAST = 5, (4, 5)
BANDS, ROWS, SEED = 20, 4, 17
BLOCK = 500_000  # shingles
PIECE = 4_096  # shingles that are permuted at a time


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def set_hash(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def band_keys(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    rng = np.random.default_rng(SEED)
    times, plus = rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
    times = times * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), PIECE):
        x = found[None, at : at + PIECE] * times + plus
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64).tolist()


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("sig"), text.alias("text"))


def _marks(documents: DataFrame) -> DataFrame:
    """doc_id, sig (a hash of the text), fp (of its set of shingles), n (shingles), bands."""
    bounded_batches(documents.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            low = 0
            for keys, buf, offsets in text_chunks(batch):
                raw = buf.tobytes()
                sets = [shingle_set(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": keys, "sig": batch.column("sig").slice(low, len(sets)), "fp": pa.array(map(set_hash, sets), pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "bands": pa.array(map(band_keys, sets), pa.list_(pa.int64()))})
                low += len(sets)

    return _keyed(documents).mapInArrow(run, "doc_id long, sig long, fp long, n long, bands array<long>")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, set (the hashes as bytes) of the texts that stand for the fps of ``wanted`` (fp, best)."""
    best = wanted.select(F.coalesce("best.doc_id", F.lit(NO_ID)).alias("_id"), F.col("best.sig").alias("sig"))
    rows = _keyed(documents).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(bounded(best), ["_id", "sig"], "left_semi").dropDuplicates(["_id", "sig"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, buf, offsets in text_chunks(batch):
                raw = buf.tobytes()
                sets = [shingle_set(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"fp": pa.array(map(set_hash, sets), pa.int64()), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    return rows.select("doc_id", "text").mapInArrow(run, "fp long, set binary")


def forest(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what pairs of similar sets connect, beyond what equal labels say."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    word = np.unique(np.concatenate(sets), return_inverse=True)[1]
    label, count = np.unique(label, return_inverse=True, return_counts=True)[1:]
    held, out = np.zeros(int(word.max()) + 1, bool), []
    order = np.argsort(count[label], kind="stable")
    most = label == label[order[-1]]
    for r in order[~most[order]].tolist() if most.any() else []:
        if (label == label[r]).all():
            break
        own = word[start[r] : start[r] + size[r]]
        held[own] = True
        shared = np.add.reduceat(held[word].astype(np.int64), start)
        held[own] = False
        near = np.flatnonzero((sum(LEAST) * shared >= LEAST[0] * (size + size[r])) & (label != label[r]))
        if len(near):
            groups, first = np.unique(label[near], return_index=True)
            out += [(r, int(k)) for k in near[first]]
            label[np.isin(label, groups)] = label[r]
    return out


def _connect(group):
    import pyarrow as pa

    fp, label = group.column("fp").to_numpy(), group.column("label").to_numpy()
    order = np.argsort(fp, kind="stable")
    raw = group.column("set").to_pylist()
    found = np.array(forest([np.frombuffer(raw[i], np.uint64) for i in order.tolist()], label[order]), np.int64).reshape(-1, 2)
    return pa.table({"a": fp[order[found[:, 0]]], "b": fp[order[found[:, 1]]]})


def links(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """a, b: links between fps (of ``distinct``: fp, best, n, bands) that connect all similar ones."""
    keyed = distinct.select("fp", "n", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("fp").alias("pivot"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum("n").alias("weight")).filter("m > 1")
    groups = groups.groupBy("m", "pivot", "x", "weight").agg(F.min("key").alias("key"))
    groups = staged(groups.select("key", "pivot", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks")), "groups")
    met = staged(keyed.join(bounded(groups), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), "met")
    sets = staged(_sets(documents, distinct.join(bounded(met.select("fp").distinct()), "fp", "left_semi")), "shingle-sets")
    ship_package(documents.sparkSession)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = met.withColumn("p", F.explode(F.when(F.col("fp") == F.col("pivot"), every).otherwise(F.array("own"))))
    first = staged(dealt.join(sets, "fp").select("key", "p", "fp", F.col("fp").alias("label"), "set").groupBy("key", "p").applyInArrow(_connect, "a long, b long").distinct(), "links")
    large = met.filter("blocks > 1")
    if not large.limit(1).count():
        return first
    roots = staged(connected_components(first), "first-roots")
    large = large.join(roots, large.fp == roots.node, "left").select("key", "blocks", "own", "fp", F.coalesce("root", "fp").alias("label"))
    apart = large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    pairs = large.join(bounded(apart), "key", "left_semi").withColumn("other", F.explode(every)).filter("own <> other")
    pairs = pairs.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "label")
    return first.union(pairs.join(sets, "fp").groupBy("key", "p", "q").applyInArrow(_connect, "a long, b long")).distinct()


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` for each group of near copies, that of the smallest id, with all columns as they were."""
    marked = staged(_marks(documents), "shingle-marks")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    distinct = staged(marked.groupBy("fp").agg(F.min(row).alias("best"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct-sets")
    roots = staged(connected_components(links(documents, distinct)), "roots")
    owner = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    best = staged(owner.select("fp", "root").join(owner.groupBy("root").agg(F.min("best").alias("best")), "root").select("fp", "best"), "components")
    id_, sig = free_name(documents, "_id"), free_name(documents, "_sig")
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.col("sig").alias(sig)]
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sig") == F.col("best.sig"))
    others = staged(marked.join(best, "fp").filter(~same).select(*key).distinct(), "near-copies")
    keyed = documents.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(sig, F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(bounded(others), [id_, sig], "left_anti")
    if marked.groupBy(*key).count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_, sig])  # rows alike in id and text
    return kept.drop(id_, sig)
