"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts kept together.

Equal texts form a group; its vector is (bytes, tokens, rows). Groups larger than 1 / ``SMALL`` of a shard in any dimension are
placed one by one (there can't be more than 3 * ``SMALL`` * shards), and the smaller ones are gathered by hash into ``CELLS``
cells, at every size of the table; so what the driver packs is bounded. A group larger than a whole shard is split into chunks, row by row. Items are placed largest first, each into the shard where the dot product
of its vector with the residual capacity is highest among the shards that still have room for it; where none has, into
the one with most room in bytes. The law that holds is ``bytes``: sizes near equal.

Edge cases: null text has no bytes and no tokens and groups with other nulls; empty texts are a group of their own;
repeated rows and repeated ids get slots of their own; null ids are allowed; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import staged, utf8_bytes

SHARDS, CELLS, SMALL = 24, 1 << 13, 64
PIECES = 8  # a group beyond one shard's capacity is cut into so many chunks a shard
ROOM = 0.002  # of the capacity, by which a shard may be overfull
SLOT_ROWS = 2_000  # rows of a shard numbered in one window, about


def pack(vectors: np.ndarray, shards: int, room: float = ROOM) -> np.ndarray:
    """The shard of each item (a row: bytes, tokens, rows)."""
    share = vectors / np.maximum(vectors.sum(0), 1) * shards  # in capacities of one shard
    left = np.ones((shards, vectors.shape[1]))
    slack = np.array([room] + [max(room, 0.05)] * (vectors.shape[1] - 1))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(1))):
        v = share[i]
        fits = (left + slack >= v)
        open_ = fits.all(1)
        if not open_.any():
            open_ = fits[:, 0]
        score = np.where(open_, left @ v, -np.inf) if open_.any() else left[:, 0]
        out[i] = int(np.argmax(score))
        left[out[i]] -= v
    return out


def assign_shards(documents: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, n_words."""
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    slim = staged(
        documents.select(
            F.col("doc_id").cast("long"),
            (utf8_bytes(text) + 8).alias("size"),
            F.coalesce(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(words, F.lit(0)).cast("long").alias("n_words"),
            F.xxhash64(text.isNull(), text).alias("grp"),
            F.monotonically_increasing_id().alias("row"),  # tells rows with one id and text apart, once written
        ),
        "shard-input",
    )
    sums = [F.sum("size").alias("b"), F.sum("n_words").alias("t"), F.count("*").alias("n")]
    groups = staged(slim.groupBy("grp").agg(*sums), "groups")
    total = slim.agg(*sums).first()
    cap = [max(1, (total[k] or 0)) / shards for k in ("b", "t", "n")]
    share = F.greatest(*(F.col(k) / F.lit(c) for k, c in zip(("b", "t", "n"), cap)))
    own = groups.withColumn("share", share).filter(F.col("share") > 1 / SMALL).select("grp", "share").orderBy("grp").collect()
    base, rows = cells, []
    for grp, x in own:
        n = int(np.ceil(x * PIECES)) if x > 1 else 1
        rows.append((grp, base, n))
        base += n
    cut = spark.createDataFrame(rows, "grp long, item_base int, n_chunks int")
    chunk = F.col("item_base") + F.pmod(F.xxhash64("row"), F.col("n_chunks"))
    with_item = slim.join(F.broadcast(cut), "grp", "left").withColumn("item", F.coalesce(chunk, F.pmod("grp", F.lit(cells))).cast("int"))
    items = with_item.groupBy("item").agg(*sums).orderBy("item").collect()  # bounded by cells and chunks
    placed = pack(np.array([[r["b"], r["t"], r["n"]] for r in items], float).reshape(-1, 3), shards)
    where = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(items, placed)], "item int, shard int")
    buckets = max(1, -(-(total["n"] or 0) // (shards * SLOT_ROWS)))
    out = with_item.join(F.broadcast(where), "item").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row"))
    return out.withColumn("number", number).join(counts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_words"
    )
