"""A table kept in versions: each is a folder of its own, and one small file names the current one.

A new version is written in full before the name is replaced, in a single rename over the old one. A run that fails at any
step leaves a whole table; readers keep the version they began with. The name also carries the number of the stream batch
that made the version, so that a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

CURRENT = "CURRENT"


def _context(spark: SparkSession, path: str):
    """Hadoop's file context for ``path`` (its rename can replace), and a function from texts to paths."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getFileSystem(conf).getUri(), conf), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> dict | None:
    """The current version of the table at ``path``: folder, batch, and the version before; None where there is none."""
    files, of = _context(spark, path)
    name = of(f"{path}/{CURRENT}")
    if not files.util().exists(name):
        return None
    stream = files.open(name)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, told: dict) -> None:
    files, of = _context(spark, path)
    jvm = spark.sparkContext._jvm
    draft = of(f"{path}/.{CURRENT}-{uuid.uuid4().hex}")
    system = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(draft)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(draft, of(f"{path}/{CURRENT}"), how)


def put(table: DataFrame, path: str, batch: int | None = None, keep: int = 2) -> bool:
    """Make ``table`` the current version; False, and nothing done, if ``batch`` or a later one made the current version. ``keep`` older versions stay for readers."""
    spark = table.sparkSession
    before = current(spark, path)
    if batch is not None and before and before["batch"] is not None and before["batch"] >= batch:
        return False
    folder = f"versions/{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{folder}")
    older = ([before["folder"], *before["older"]] if before else [])[: keep + 1]
    _point(spark, path, {"folder": folder, "batch": batch if batch is not None else before and before["batch"], "older": older[:keep]})
    files, of = _context(spark, path)
    for gone in older[keep:]:
        files.delete(of(f"{path}/{gone}"), True)
    return True


def get(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version, an empty table where there is none; later versions don't change what is read."""
    told = current(spark, path)
    if told is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{told['folder']}")
