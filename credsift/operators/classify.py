"""The verdict on a finding: the first step of a fixed ladder that applies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import APP_PATHS, CALLS, CONFIDENCE, DUMMY_MARKERS, ENV_REFERENCES, FIXTURE_PATHS, PLACEHOLDERS, REFERENCE_KEYS
from ..functions.text import language, parse_verdict, severity_rank


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("/", "/") for w in words)


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^[\"'`]+|[\"'`]+$", "")


def fixture_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(_any(FIXTURE_PATHS))


def app_path(path: Column) -> Column:
    return path.rlike("^(?:" + _any(APP_PATHS) + ")")


def dummy(value: Column) -> Column:
    return F.lower(value).rlike(_any(DUMMY_MARKERS))


def env_reference(value: Column) -> Column:
    v = _bare(value)
    return v.rlike(r"(?s)^\$\{.*\}\z") | v.rlike(r"^\$[A-Za-z_][A-Za-z0-9_]*\z") | ((F.octet_length(v) > 2) & v.rlike(r"(?s)^%.*%\z")) | F.lower(v).rlike(_any(ENV_REFERENCES))


def placeholder(value: Column) -> Column:
    v = _bare(value)
    wrapped = v.rlike(r"(?s)^(?:[#$%]?\{.*\}|<.*>)\z")
    masked = v.rlike(r"^[*xX._-]+\z") & (F.octet_length(v) >= 3)
    flat = (F.octet_length(v) >= 8) & (F.size(F.array_distinct(F.split(v, ""))) <= 2)
    return (v == "") | wrapped | v.rlike(_any(PLACEHOLDERS)) | masked | flat


def secret_reference(value: Column, context: Column) -> Column:
    v = _bare(value)
    beside = F.exists(context, lambda x: F.contains(x, v) & F.lower(x).rlike(_any(REFERENCE_KEYS)))
    path = v.rlike(r"^[a-z0-9/._-]*\z") & v.rlike("[^/]/+[^/]")
    return beside | path


def pared(findings: DataFrame, lines: bool = False) -> DataFrame:
    """``findings`` without their context: ``referenced`` holds what the ladder reads of it; with ``lines`` the first line that holds the value stays
    in files of a language that proposals are made for.

    Context is most of a finding's bytes, so what is kept or shuffled goes without it.
    """
    out = findings.withColumn("referenced", secret_reference(F.col("match"), F.col("context")))
    line = F.slice(F.filter("context", lambda x: F.contains(x, F.col("match"))), 1, 1)
    return out.withColumn("context", F.when(language(F.col("path")).isin(*CALLS), line)) if lines else out.drop("context")


def classify(findings: DataFrame) -> DataFrame:
    """``findings`` with step, verdict, confidence, reason, and a severity that known leaks raise.

    Reads match, path, severity, context (``pared``: referenced) and, where they are present, catalog_id, catalog_verdict, status,
    provider and status_reason.
    """
    referenced = F.col("referenced") if "referenced" in findings.columns else secret_reference(F.col("match"), F.col("context"))
    for name in ("catalog_id", "catalog_verdict", "status", "provider", "status_reason"):
        if name not in findings.columns:
            findings = findings.withColumn(name, F.lit(None).cast("string"))
    m, path = F.col("match"), F.col("path")
    known = F.col("catalog_verdict")
    step = (
        F.when(known == "FIXTURE", "catalog_fixture").when(known == "KNOWN_LEAKED", "catalog_leaked").when(known == "HONEYTOKEN", "catalog_honeytoken")
        .when(F.col("status") == "verified", "verified").when(F.col("status") == "invalid", "invalid")
        .when(fixture_path(path), "fixture_path").when(dummy(m), "dummy").when(env_reference(m), "env_reference").when(placeholder(m), "placeholder")
        .when(referenced, "secret_reference")
        .when((severity_rank(F.col("severity")) >= 3) & app_path(path), "app_path").otherwise("inconclusive")
    )
    out = findings.withColumn("step", step)
    real = F.col("step").isin("catalog_leaked", "catalog_honeytoken", "verified", "app_path")
    confidence = F.coalesce(*(F.when(F.col("step") == k, F.lit(float(c))) for k, c in CONFIDENCE.items()))
    reason = (
        F.when(F.col("step").startswith("catalog"), F.concat(F.lit("known value: "), "catalog_id"))
        .when(F.col("step") == "verified", F.concat(F.lit("verified with "), "provider"))
        .when(F.col("step") == "invalid", F.concat("provider", F.lit(" rejects it")))
        .when(F.col("step") != "inconclusive", F.concat(F.lit("heuristic: "), "step"))
        .when(F.col("status") == "unverified", F.concat(F.lit("inconclusive; "), "provider", F.lit(" could not tell: "), F.coalesce("status_reason", F.lit(""))))
        .otherwise("inconclusive; not verified")
    )
    severity = F.when(F.col("step") == "catalog_leaked", "high").when(F.col("step") == "catalog_honeytoken", "critical").otherwise(F.col("severity"))
    return out.withColumn("verdict", F.when(real, "real").when(F.col("step") == "inconclusive", "unknown").otherwise("fixture")).withColumn("confidence", confidence).withColumn("reason", reason).withColumn("severity", severity)


def apply_host_verdicts(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """Overwrite verdict, reason and confidence by position ``id`` from JSON answers (column ``json``); the last answer for an id counts."""
    schema = "array<struct<id:string,verdict:string,reason:string,confidence:double>>"
    rows = answers.select(F.posexplode(F.from_json("json", schema)).alias("pos", "a")).withColumn("id", F.expr("try_cast(a.id as bigint)")).filter("id is not null")
    last = rows.groupBy("id").agg(F.max_by("a", "pos").alias("a"))
    clean = F.lower(F.trim("a.verdict"))
    verdict = F.when(clean.isin("real", "fixture"), clean).otherwise("unknown")
    out = findings.join(last, "id", "left")
    for name, value in (("verdict", verdict), ("reason", F.col("a.reason")), ("confidence", F.col("a.confidence"))):
        out = out.withColumn(name, F.when(F.col("a").isNotNull(), value).otherwise(F.col(name)))
    return out.drop("a")


HYDRATED = "path string, line int, column int, match string, match_redacted string, pattern string, severity string, context array<string>, verdict string, reason string, confidence double"


def hydrated(candidates: DataFrame) -> DataFrame:
    """Findings from JSON (column ``json``) that a host gives back, with defaults for what is missing; the redacted value stands in for the value."""
    given = candidates.select(F.from_json("json", HYDRATED).alias("c")).select("c.*")
    known = F.when(F.col("severity").isin("critical", "high", "medium", "low"), F.col("severity")).otherwise("unknown")
    clean = F.filter(F.coalesce("context", F.array().cast("array<string>")), lambda x: x.isNotNull())
    at = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(1)
    return given.select(
        F.coalesce("path", F.lit("")).alias("path"), at("line").alias("line"), at("column").alias("column"), F.coalesce("match", "match_redacted", F.lit("")).alias("match"),
        F.coalesce("pattern", F.lit("unknown")).alias("pattern"), known.alias("severity"), clean.alias("context"), parse_verdict(F.coalesce("verdict", F.lit("unknown"))).alias("verdict"), "reason", "confidence",
    )
