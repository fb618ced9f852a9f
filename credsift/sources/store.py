"""Results kept between steps: Parquet in the folder that driver and executors share.

Findings are written with their raw values encrypted (AES-GCM) under a key that lives as long as the Spark context.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Columns of findings that hold raw values.
SECRET = ("match", "context")
#: A table below so many bytes for each core has fewer input splits than cores.
SPLIT_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary folder; on a cluster that is an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="credsift-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: whatever is built on it doesn't compute it again, and a lost executor costs no more than a read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = df.sparkSession.sparkContext
    sc._credsift_written = [*getattr(sc, "_credsift_written", []), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _key(spark: SparkSession) -> bytes:
    """The key of this run, which nothing stores."""
    sc = spark.sparkContext
    if not hasattr(sc, "_credsift_key"):
        sc._credsift_key = os.urandom(32)
    return sc._credsift_key


def sealed(df: DataFrame, columns=SECRET) -> DataFrame:
    """``df`` with the columns that hold raw values encrypted under the run's key."""
    key = F.lit(bytearray(_key(df.sparkSession)))
    some = [f for f in df.schema if f.name in columns]
    return df.withColumns({f.name: F.aes_encrypt(F.col(f.name) if f.dataType == StringType() else F.to_json(F.struct(f.name)), key) for f in some})


def unsealed(df: DataFrame, schema: StructType) -> DataFrame:
    """What ``sealed`` made of a frame of ``schema``, readable again."""
    key = F.lit(bytearray(_key(df.sparkSession)))
    some = [f for f in schema if f.name in SECRET]

    def plain(f) -> Column:
        text = F.aes_decrypt(f.name, key).cast("string")
        return text if f.dataType == StringType() else F.from_json(text, StructType([f]))[f.name]

    return df.withColumns({f.name: plain(f) for f in some}).select(*schema.names)


def written_sealed(df: DataFrame, name: str) -> DataFrame:
    """``written`` for findings: no raw value reaches a file."""
    return unsealed(written(sealed(df), name), df.schema)


def discard(spark: SparkSession) -> None:
    """Delete all that ``written`` has left in this session."""
    made = getattr(spark.sparkContext, "_credsift_written", [])
    jvm = spark.sparkContext._jvm
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(table: DataFrame) -> DataFrame:
    """A table just read, its rows dealt over all cores where its files are fewer than these.

    A row group is one task's work; a small table is often a single one, which would leave all other cores idle. Tables of many
    files are left as they are: nothing is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * SPLIT_BYTES and len(table.inputFiles()) < cores:
        return table.repartition(cores)
    return table


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_credsift_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="credsift-")) / "credsift.zip"  # Spark copies it to the workers
    with zipfile.ZipFile(target, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._credsift_shipped = True
