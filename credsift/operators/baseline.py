"""What is known from earlier runs: merging findings in, and what is new, rotated or was ever verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redacted
from ..sources import versions

SCHEMA = "fingerprint string, kind string, key_preview string, status string, first_seen_at timestamp, last_verified_at timestamp, verification_attempts int, ever_verified boolean, first_path string, first_line int"


def merge(baseline: DataFrame, findings: DataFrame, now: str) -> DataFrame:
    """The new baseline. Findings count in the order of path, line, column and pattern; entries never go."""
    place = F.struct("path", "line", "column", "pattern_ord")
    verified = F.col("status") == "verified"
    seen = findings.filter("fingerprint is not null").groupBy("fingerprint").agg(
        F.count("*").cast("int").alias("n"),
        F.bool_or(F.coalesce(verified, F.lit(False))).alias("any_v"),
        F.bool_or(F.col("verdict") == "fixture").alias("any_f"),
        F.max_by(F.coalesce(verified, F.lit(False)), place).alias("last_v"),
        F.min_by(F.struct("pattern", redacted(F.col("match")).alias("preview"), "path", "line"), place).alias("f"),
    )
    stamp = F.lit(now).cast("timestamp")
    both = baseline.alias("b").join(seen.alias("s"), "fingerprint", "full_outer")
    hit, old = F.col("n").isNotNull(), lambda c: F.col(f"b.{c}")
    ever = F.coalesce(old("ever_verified"), F.lit(False)) | F.coalesce(F.col("any_v"), F.lit(False))
    was = F.coalesce(old("status"), F.lit("active"))
    status = F.when(~hit, was).when(F.col("last_v"), "active").when(ever, "rotated").when(F.col("any_f"), "fixture").otherwise(was)
    return both.select(
        "fingerprint", F.coalesce(old("kind"), "f.pattern").alias("kind"), F.coalesce(old("key_preview"), "f.preview").alias("key_preview"), status.alias("status"),
        F.coalesce(old("first_seen_at"), stamp).alias("first_seen_at"), F.when(F.col("any_v"), stamp).otherwise(old("last_verified_at")).alias("last_verified_at"),
        (F.coalesce(old("verification_attempts"), F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("verification_attempts"), ever.alias("ever_verified"),
        F.coalesce(old("first_path"), "f.path").alias("first_path"), F.coalesce(old("first_line"), "f.line").cast("int").alias("first_line"),
    )


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def present(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    return baseline.join(findings.select("fingerprint"), "fingerprint", "left_semi")


def diff_stats(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row of counts: findings, new, known, ever verified, rotated."""
    known = findings.select("fingerprint", F.lit(1).alias("one")).join(baseline.select("fingerprint", F.lit(1).alias("known")), "fingerprint", "left")
    here = present(baseline, findings).agg(F.count("*").alias("present"), F.count_if("ever_verified").alias("ever_verified"), F.count_if(F.col("status") == "rotated").alias("rotated"))
    return known.agg(F.count("*").alias("findings"), F.count_if(F.col("known").isNull()).alias("new")).crossJoin(here)  # one row each


def mark_ignored(baseline: DataFrame, fingerprint: str) -> DataFrame:
    """``baseline`` with one entry marked as ignored; an error if it isn't there."""
    if not baseline.filter(F.col("fingerprint") == fingerprint).limit(1).count():
        raise KeyError(f"no entry of the baseline has the fingerprint {fingerprint}")
    return baseline.withColumn("status", F.when(F.col("fingerprint") == fingerprint, "ignored").otherwise(F.col("status")))


def history_events(findings: DataFrame, now: str) -> DataFrame:
    """ts, event, fingerprint, commit (of findings in a history), path, line, extra: DETECTED for each finding, VERIFIED_LIVE for each that verified."""
    commit = F.col("sha") if "sha" in findings.columns else F.lit(None).cast("string")
    base = findings.select(F.lit(now).cast("timestamp").alias("ts"), "fingerprint", commit.alias("commit"), "path", "line", "status", "provider")
    kinds = F.when(F.col("status") == "verified", F.array(F.lit("DETECTED"), F.lit("VERIFIED_LIVE"))).otherwise(F.array(F.lit("DETECTED")))
    rows = base.withColumn("event", F.explode(kinds))
    extra = F.when(F.col("event") == "VERIFIED_LIVE", F.to_json(F.struct("provider", F.lit("live_api_call").alias("method"))))
    return rows.select("ts", "event", "fingerprint", "commit", "path", "line", extra.alias("extra"))


def read_baseline(spark, path: str) -> DataFrame:
    """A baseline as ``write_baseline`` leaves it, pinned to its present version; or a JSON file with ``entries`` by fingerprint."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or files.getFileStatus(where).isDirectory():
        return versions.get(spark, path, SCHEMA)
    value = SCHEMA.replace("fingerprint string, ", "")
    raw = spark.read.json(path, multiLine=True, schema="entries map<string, struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split() for x in value.split(", "))) + ">>")
    return raw.select(F.explode("entries").alias("fingerprint", "e")).select("fingerprint", "e.*")


def write_baseline(baseline: DataFrame, path: str, batch: int | None = None) -> bool:
    """A new version of the baseline at ``path``, ordered by fingerprint; of a stream's batch only once."""
    return versions.put(baseline.orderBy("fingerprint"), path, batch)


def append_history(events: DataFrame, path: str) -> None:
    """Adds ``history_events`` to the JSON lines at ``path``."""
    events.write.mode("append").json(path)


def read_history(spark, path: str) -> DataFrame:
    return spark.read.schema("ts timestamp, event string, fingerprint string, commit string, path string, line int, extra string").json(path)
