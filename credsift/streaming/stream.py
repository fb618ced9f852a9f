"""The scanner on streams: scanning of new rows, detections counted by event time, and baselines that follow a stream."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators import baseline
from ..operators.scan import scan
from ..sources.store import SECRET, sealed, shared_dir, ship_package, unsealed


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def scan_stream(rows: DataFrame) -> DataFrame:
    """Findings of a stream of files (path, text); no state is kept."""
    return scan(rows)


def scan_available(spark: SparkSession, path: str) -> DataFrame:
    """Scan the documents under ``path`` as a stream, all that is there now, and read what the sink holds."""
    folder = shared_folder(spark)
    schema = spark.read.parquet(path).schema
    head, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(head) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    files = source.select(F.concat(F.lit("docs_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    found = scan_stream(files)
    query = sealed(found).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    stored = StructType([f if f.name not in SECRET else StructField(f.name, BinaryType()) for f in found.schema])
    return unsealed(spark.read.schema(stored).parquet(f"{folder}/out"), found.schema)


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def detections_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """pattern, window, n from a stream (or table) of detections (ts, pattern); rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "pattern").agg(F.count("*").alias("n"))


def merge_stream(findings: DataFrame, path: str, now: str | None = None, folder: str | None = None):
    """Merge a stream of findings (fingerprint, path, line, column, pattern, pattern_ord, match, status, verdict) into the baseline at ``path``, batch by batch.

    A batch that runs again after a failure finds its number on the current version and changes nothing. Progress is kept
    beside the baseline unless ``folder`` is given.
    """

    def merge(batch: DataFrame, number: int) -> None:
        stamp = now or f"{datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S}"
        baseline.write_baseline(baseline.merge(baseline.read_baseline(batch.sparkSession, path), batch, stamp), path, number)

    return findings.writeStream.foreachBatch(merge).option("checkpointLocation", folder or f"{path}/progress").trigger(availableNow=True).start()


#: What is kept of a fingerprint between batches, and what goes out when it changes.
STATE = "first_ms long, seen_ms long, attempts int, ever boolean, status string"
CHANGE = "fingerprint string, status string, verification_attempts int, ever_verified boolean, first_seen_at timestamp, last_seen_at timestamp"


def _folded(key, frames, state, quiet_ms: int):
    """The baseline's rule for one fingerprint: rows in their order, and what was verified counts as rotated once it is seen no more."""
    import pandas as pd

    first, seen, attempts, ever, status = state.get if state.exists else (None, None, 0, False, "active")
    if state.hasTimedOut:
        status = "rotated" if ever else status
    for frame in frames:
        for row in frame.sort_values(["ts", "path", "line", "column", "pattern_ord"], kind="stable").itertuples(index=False):
            at = int(row.ts.timestamp() * 1000)
            first, seen, attempts = at if first is None else min(first, at), max(seen or at, at), attempts + 1
            if row.status == "verified":
                status, ever = "active", True
            elif ever:
                status = "rotated"
            elif row.verdict == "fixture":
                status = "fixture"
    state.update((first, seen, attempts, ever, status))
    if not state.hasTimedOut and ever and status == "active":
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + quiet_ms)
    yield pd.DataFrame({"fingerprint": [key[0]], "status": [status], "verification_attempts": pd.array([attempts], "Int32"), "ever_verified": [ever], "first_seen_at": [pd.Timestamp(first, unit="ms")], "last_seen_at": [pd.Timestamp(seen, unit="ms")]})


def rolling_baseline(findings: DataFrame, late: str = "1 hour", quiet: timedelta = timedelta(days=30)) -> DataFrame:
    """Changes of the baseline as a stream of findings (ts, fingerprint, path, line, column, pattern_ord, status, verdict) goes by, one row a fingerprint and batch.

    State is a few numbers a fingerprint, spread over partitions. A verified value that isn't seen for ``quiet`` of event
    time counts as rotated, by a timer.
    """
    ship_package(findings.sparkSession)
    ms = int(quiet.total_seconds() * 1000)
    rows = findings.withWatermark("ts", late).select("fingerprint", "ts", "path", "line", "column", "pattern_ord", "status", "verdict")
    return rows.groupBy("fingerprint").applyInPandasWithState(lambda key, frames, state: _folded(key, frames, state, ms), CHANGE, STATE, "update", "EventTimeTimeout")
