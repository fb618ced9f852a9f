"""Small helpers shared by the operators: tables, staged results and bounded Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir, ship_package, spread

#: Rows and bytes of one Arrow batch sent to Python; texts may be long, so both are held down.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Rows of about 100 bytes up to which a side of a join is broadcast.
BROADCAST_ROWS = 300_000
#: Stands for a null document id in keys.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; rows of a small one in few files are dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a ``staged`` frame that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if a count shows that it has few rows; else Spark shuffles both sides of a join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def bounded_batches(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_chunks(batch, id_col: str = "doc_id", text_col: str = "text", limit: int = BATCH_BYTES):
    """Cut an Arrow batch into runs of rows of about ``limit`` bytes: (ids, buffer, offsets), nulls as empty texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(batch.column(text_col).cast(pa.large_binary()), b"")
    ids = batch.column(id_col)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        at = offsets[low : high + 1]
        yield ids.slice(low, high - low), data[at[0] : at[-1]], at - at[0]
        low = high
