"""Verification: which requests to make, the transport, and what an answer means.

Planning and judging are joins and expressions; only the transport leaves Spark, as a callable given by the user. A
value is asked about once for each provider, whatever the number of its findings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lists import PROVIDERS, UNVERIFIED
from ..functions.patterns import patterns

FALLBACK = "external_scanner"
#: Begins the error of a request that can't be made for want of a paired value.
MISSING = "missing: "
RESPONSE = "provider string, match string, http_status int, body string, error string"


def verifier_frame(spark: SparkSession) -> DataFrame:
    """pattern, provider, ord: who verifies what; the fallback comes last."""
    rows = [(p, name, i) for i, (name, handled, _, _) in enumerate(PROVIDERS) for p in handled.split()]
    rows += [(p.id, FALLBACK, len(PROVIDERS)) for p in patterns() if p.id not in UNVERIFIED]
    return spark.createDataFrame(rows, "pattern string, provider string, ord int")


def provider_names() -> list[str]:
    """Who verifies, in the order in which they are asked; the fallback last."""
    return [name for name, *_ in PROVIDERS] + [FALLBACK]


def plan_requests(findings: DataFrame) -> DataFrame:
    """provider, pattern, match: one row for each request to make."""
    return findings.join(F.broadcast(verifier_frame(findings.sparkSession)), "pattern").select("provider", "pattern", "match").distinct()


def send(requests: DataFrame, transport: Callable[[str, str, str], tuple[int | None, str | None, str | None]], concurrency: int = 8) -> DataFrame:
    """Responses to requests; ``transport(provider, pattern, match)`` gives status, body and error. At most ``concurrency`` tasks ask at a time."""

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            got = [transport(*row) for row in batch[["provider", "pattern", "match"]].itertuples(index=False)]
            yield pd.DataFrame({"provider": batch["provider"], "match": batch["match"], "http_status": pd.array([g[0] for g in got], "Int32"), "body": [g[1] for g in got], "error": [g[2] for g in got]})

    return requests.repartition(concurrency).mapInPandas(run, RESPONSE)


def outcome() -> Column:
    """status, reason and meta of a response (provider, http_status, body, error)."""
    code, body = F.col("http_status"), F.col("body")
    good = code.between(200, 299)
    bad = F.lit(False)
    for name, _, statuses, _ in PROVIDERS:
        if statuses:
            bad = bad | ((F.col("provider") == name) & code.isin([int(s) for s in statuses.split()]))
    refused = good & (((F.col("provider") == "slack") & (F.coalesce(F.get_json_object(body, "$.ok"), F.lit("false")) != "true")) | ((F.col("provider") == "datadog") & (F.coalesce(F.get_json_object(body, "$.valid"), F.lit("false")) != "true")))
    meta = F.lit(None).cast("string")
    for name, _, _, fields in PROVIDERS:
        if fields:
            meta = F.when(F.col("provider") == name, F.to_json(F.struct(*(F.get_json_object(body, f"$.{x}").alias(x) for x in fields.split())))).otherwise(meta)
    status = F.when(F.col("error").isNotNull(), "unverified").when(refused | F.coalesce(bad, F.lit(False)), "invalid").when(good, "verified").otherwise("unverified")
    reason = F.when(F.col("error").startswith(MISSING), F.expr(f"substring(error, {len(MISSING) + 1})")).when(F.col("error").isNotNull(), F.concat(F.lit("network: "), F.left("error", F.lit(120)))).when(status == "unverified", F.concat(F.lit("unexpected HTTP "), F.coalesce(code.cast("string"), F.lit("-"))))
    return F.struct(status.alias("status"), reason.alias("status_reason"), F.when(status == "verified", meta).alias("meta"))


def answers(responses: DataFrame) -> DataFrame:
    """match, answers: what was said of each value, each answer with its rank among them."""
    told = responses.withColumn("o", outcome())
    status, turn = F.col("o.status"), F.array_position(F.array(*map(F.lit, provider_names())), F.col("provider"))
    priority = F.when(status == "verified", 3).when(status == "invalid", 2).otherwise(1)
    rank = F.when(priority == 3, -turn).otherwise(turn)
    return told.groupBy("match").agg(F.collect_list(F.struct(priority.alias("priority"), rank.alias("rank"), "provider", "o")).alias("answers"))


def judge(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """``findings`` with the best outcome: verified before invalid before unverified; of equals the later verifier, but the first that verifies.

    They meet their answers by value alone, so what else is joined by value needs no further shuffle of them.
    """
    handled = {p.id: [name for name, some, _, _ in PROVIDERS if p.id in some.split()] + [FALLBACK] * (p.id not in UNVERIFIED) for p in patterns()}
    who = F.create_map(*(x for p, names in handled.items() if names for x in (F.lit(p), F.array(*map(F.lit, names)))))[F.col("pattern")]
    best = F.array_max(F.filter("answers", lambda a: F.array_contains(who, a["provider"])))
    findings = findings.drop("provider", "status", "status_reason", "meta")  # of an earlier run
    rows = findings.join(answers(responses), "match", "left").withColumn("b", best)
    return rows.select("*", F.col("b.provider").alias("provider"), "b.o.status", "b.o.status_reason", "b.o.meta").drop("b", "answers")


#: Provider, what a line with a host holds, and the host (group 1). Runs of name characters are entered at their start
#: and never again, so a line of any length is read once.
HOSTS = {
    "shopify": ([".myshopify.com"], r"(?<![a-zA-Z0-9-])-*+([a-zA-Z0-9][a-zA-Z0-9-]*+\.myshopify\.com)"),
    "databricks": ([".cloud.databricks.com", ".azuredatabricks.net"], r"((?<![a-zA-Z0-9-])[a-zA-Z0-9-]++\.cloud\.databricks\.com|adb-[0-9]++\.[0-9]++\.azuredatabricks\.net)"),
}


def tenant_hosts(findings: DataFrame) -> DataFrame:
    """provider, host: the first host of each tenant provider, by the order of findings and of lines in them."""
    lines = F.concat(F.coalesce("context", F.array().cast("array<string>")), F.array("match"))

    def first(name: str) -> Column:
        marks, regex = HOSTS[name]
        some = F.filter(lines, lambda x: reduce(or_, (F.contains(x, F.lit(m)) for m in marks)))
        found = F.filter(F.transform(some, lambda x: F.regexp_extract(x, regex, 1)), lambda h: h != "")
        return F.struct(F.lit(name).alias("provider"), F.get(found, F.lit(0)).alias("host"))

    place = F.struct("path", "line", "column", "pattern_ord")
    rows = findings.select(place.alias("place"), F.inline(F.array(*map(first, HOSTS)))).filter("host is not null")
    return rows.groupBy("provider").agg(F.min_by("host", "place").alias("host"))


def paired_values(findings: DataFrame) -> DataFrame:
    """pattern, match: the last secret key and session token of the run, which requests with an access key need."""
    place = F.struct("path", "line", "column", "pattern_ord")
    return findings.filter(F.col("pattern").isin("aws_secret_key", "aws_session_token")).groupBy("pattern").agg(F.max_by("match", place).alias("match"))
