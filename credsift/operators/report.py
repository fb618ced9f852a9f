"""Reports: the redacted view, SARIF results, groups and totals, exit codes, prompts. No raw value leaves here."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import patterns
from ..functions.text import redacted
from .scan import numbered

VIEW = ["path", "line", "column", "match_redacted", "pattern", "severity", "verdict", "reason", "confidence", "status", "provider", "fingerprint"]


def finding_view(findings: DataFrame, show_fixtures: bool = True) -> DataFrame:
    rows = findings if show_fixtures else findings.filter("verdict <> 'fixture'")
    return rows.withColumn("match_redacted", redacted(F.col("match"))).select(*[c for c in VIEW if c == "match_redacted" or c in findings.columns])


def sarif_level(severity: Column, verdict: Column) -> Column:
    return F.when(verdict == "fixture", "note").when(verdict == "unknown", "warning").when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id, level, message, uri, start_line, start_column, in the shape of SARIF results."""
    text = F.concat("pattern", F.lit(": "), redacted(F.col("match")), F.lit(" ("), "verdict", F.lit(")"))
    return findings.select(F.col("pattern").alias("rule_id"), sarif_level(F.col("severity"), F.col("verdict")).alias("level"), text.alias("message"), F.col("path").alias("uri"), F.col("line").alias("start_line"), F.col("column").alias("start_column"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """Results as JSON lines, with the rules beside them; a run of any size is written by the executors."""
    sarif_results(findings).write.mode("overwrite").json(f"{path}/results")
    rules = [(json.dumps({"id": p.id, "severity": p.severity}),) for p in patterns()]
    findings.sparkSession.createDataFrame(rules, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rules")


def write_document(lines: DataFrame, head: str, tail: str, path: str, between: str = ",") -> None:
    """One file at ``path``: ``head``, the rows of ``lines`` (id, value) in order with ``between`` before all but the first, and ``tail``.

    Executors write the rows in ordered parts beside ``path``; the file system joins the parts, or they are copied through in
    pieces where it can't. No row passes through Python on the driver.
    """
    spark = lines.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    comma = F.when(F.col("id") > 0, F.lit(between)).otherwise(F.lit(""))
    lines.repartitionByRange("id").sortWithinPartitions("id").select(F.concat(comma, "value").alias("value")).write.text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(conf)
    parts = sorted((f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/document")
    out = files.create(draft)
    out.write(bytearray(head.encode()))
    for part in parts:
        source = files.open(part)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.write(bytearray(tail.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files.delete(target, False)
    files.rename(draft, target)
    files.delete(where, True)


def write_json(findings: DataFrame, path: str, show_fixtures: bool = True) -> None:
    """One JSON array of the redacted view, in order."""
    rows = numbered(findings if show_fixtures else findings.filter("verdict <> 'fixture'"))
    view = [c for c in VIEW if c == "match_redacted" or c in rows.columns]
    shown = rows.withColumn("match_redacted", redacted(F.col("match")))
    write_document(shown.select("id", F.to_json(F.struct(*view), {"ignoreNullFields": "false"}).alias("value")), "[\n", "]\n", path)


def write_sarif_document(findings: DataFrame, path: str, show_fixtures: bool = True) -> None:
    """One SARIF 2.1.0 document of a run, with all rules; findings in order, with their commits if they come from a history."""
    rows = numbered(findings if show_fixtures else findings.filter("verdict <> 'fixture'"))
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.concat("pattern", F.lit(": "), redacted(F.col("match")), F.lit(" ("), "verdict", F.lit(")"))
    more = F.struct("verdict", have("confidence").cast("double").alias("confidence"), F.coalesce(have("status") == "verified", F.lit(False)).alias("verified"), have("provider").alias("provider"), have("fingerprint").alias("fingerprint"), have("sha").alias("git_commit"), have("subject").alias("git_commit_subject"))
    result = F.struct(F.col("pattern").alias("ruleId"), sarif_level(F.col("severity"), F.col("verdict")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"), more.alias("properties"))
    level = lambda s: {"critical": "error", "high": "error", "medium": "warning"}.get(s, "note")
    rules = [{"id": p.id, "name": p.id, "defaultConfiguration": {"level": level(p.severity)}} for p in patterns()]
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "credsift", "rules": rules}}, "results": []}]})
    write_document(rows.select("id", F.to_json(result, {"ignoreNullFields": "false"}).alias("value")), head[: -len("]}]}")] + "\n", "]}]}\n", path)


def only_verified(findings: DataFrame) -> DataFrame:
    """What a run that shows verified findings only shows; its exit code still comes from all of them."""
    return findings.filter("status = 'verified'")


def cache_keys(findings: DataFrame) -> DataFrame:
    """``findings`` with cache_key: equal for equal patterns, redacted values and contexts, wherever they stand."""
    context = F.array_join(F.transform("context", lambda x: F.concat(x, F.lit("\n"))), "")
    return findings.withColumn("cache_key", F.sha2(F.concat("pattern", F.lit("\0"), redacted(F.col("match")), F.lit("\0"), context), 256))


def percent(confidence: Column) -> Column:
    """A confidence as it is shown."""
    return F.round(confidence * 100).cast("int")


def short_sha(sha: Column) -> Column:
    return F.left(sha, F.lit(8))


def by_commit_and_path(findings: DataFrame) -> DataFrame:
    """repo, commit (short), path, n, patterns: a row for each file of a commit that has findings."""
    order = F.sort_array(F.collect_list(F.struct("line", "column", "pattern_ord", "pattern")))
    rows = findings.groupBy("repo", "sha", "path").agg(F.count("*").alias("n"), F.array_join(F.transform(order, lambda x: x["pattern"]), ",").alias("patterns"))
    return rows.select("repo", short_sha(F.col("sha")).alias("commit"), "path", "n", "patterns")


def sarif_documents(findings: DataFrame) -> DataFrame:
    """path, sarif: a SARIF 2.1.0 document of each file's findings, with all rules."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.concat("pattern", F.lit(": "), redacted(F.col("match")), F.lit(" ("), "verdict", F.lit(")"))
    result = F.struct("line", "column", "pattern_ord", F.struct(F.col("pattern").alias("ruleId"), sarif_level(F.col("severity"), F.col("verdict")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations")).alias("r"))
    rows = findings.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(result)), lambda x: x["r"]).alias("results"))
    rules = F.array(*(F.struct(F.lit(p.id).alias("id"), F.struct(F.lit(p.severity).alias("severity")).alias("properties")) for p in patterns()))
    run = F.struct(F.struct(F.struct(F.lit("credsift").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), "results")
    return rows.select("path", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "real").alias("real"), F.count_if(F.coalesce(F.col("status") == "verified", F.lit(False))).alias("verified"), F.count_if(F.col("verdict") == "unknown").alias("unknown"))


def by_path(findings: DataFrame) -> DataFrame:
    """path, n, patterns: a row for each file with its findings' patterns in order."""
    return findings.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "column", "pattern_ord", "pattern"))), lambda x: x["pattern"]), ",").alias("patterns"))


def exit_codes(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """mode, code: what a run with each failure rule exits with."""
    verified = F.coalesce(F.col("status") == "verified", F.lit(False))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    f = findings.agg(any_(F.col("verdict") == "real").alias("real"), any_(F.col("verdict") != "fixture").alias("any"), any_(verified).alias("verified"))
    b = baseline.agg(any_(F.col("ever_verified")).alias("ever"))
    one = f.crossJoin(b)  # one row each
    modes = {"none": F.lit(False), "any": F.col("any"), "real": F.col("real"), "verified": F.col("verified"), "best_effort": F.col("real"), "only_verified": F.col("verified"), "ever_verified": F.col("verified") | F.col("ever")}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mode"), v.cast("int").alias("code")) for k, v in modes.items()))).alias("x")).select("x.*")


def prompt_candidates(findings: DataFrame) -> DataFrame:
    """id, path, pattern, severity, match_redacted, context: what a host model is shown of numbered findings (else numbered here), the value redacted in every line."""
    if "id" not in findings.columns:
        findings = numbered(findings)
    shown = redacted(F.col("match"))
    return findings.select(F.col("id").cast("string").alias("id"), "path", "line", "column", "pattern", "severity", shown.alias("match_redacted"), F.array_join(F.transform("context", lambda x: F.replace(x, F.col("match"), shown)), "\n").alias("context"))
