"""Requests to providers as rows: address, headers and body from a table of endpoints, values paired with a finding, and signatures.

Everything up to sending is joins and expressions. A request that needs a value which the run hasn't found isn't made: it gets an
outcome that says what is missing. The values paired are few and alike for all findings of a run, one row of a map.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.endpoints import ENDPOINTS, OTHER_NAMES, PAIR_NAMES, REGION, SERVICE, SIGNING_NAME, TOKEN_NAME
from ..functions.text import hmac_sha256
from .verify import FALLBACK, MISSING, RESPONSE, paired_values, tenant_hosts, verifier_frame

TIMEOUT, CONCURRENCY, SHOWN = 10, 8, 120


def pairs(findings: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    """One row with ``pairs``, a map from names to values: ``given`` ones (of an environment, say), then those of the run's findings."""
    names = F.create_map(*(F.lit(x) for item in PAIR_NAMES.items() for x in item))
    rows = paired_values(findings).select(names[F.col("pattern")].alias("name"), F.col("match").alias("value"))
    rows = rows.union(tenant_hosts(findings).select(names[F.col("provider")], "host")).filter("value is not null")
    found = rows.groupBy("name").agg(F.min("value").alias("value"))  # one row a name already
    kept = F.create_map(*(F.lit(x) for item in (given or {}).items() for x in item)) if given else F.create_map().cast("map<string,string>")
    merged = F.map_from_entries(F.collect_list(F.struct("name", "value")))
    return found.agg(merged.alias("found")).select(F.map_concat(F.map_filter(kept, lambda k, v: ~F.map_contains_key("found", k)), "found").alias("pairs"))


def endpoint_frame(spark: SparkSession) -> DataFrame:
    """provider, method, url, sends, headers, body, needs: the endpoints, and the names that each needs."""
    rows = []
    for provider, method, url, sends, headers, body in ENDPOINTS:
        needs = re.findall(r"\{([A-Z_]+)\}", url + sends) + [SIGNING_NAME] * (sends == "signed")
        rows.append((provider, method, url, sends, headers, body, needs))
    return spark.createDataFrame(rows, "provider string, method string, url string, sends string, headers map<string,string>, body string, needs array<string>")


def _paired(name: Column) -> Column:
    other = F.create_map(*(F.lit(x) for item in OTHER_NAMES.items() for x in item))
    return F.coalesce(F.col("pairs")[name], F.col("pairs")[other[name]])


def _filled(text: Column) -> Column:
    """``text`` with the names in braces replaced by their values."""
    return F.reduce("needs", text, lambda t, n: F.replace(t, F.concat(F.lit("{"), n, F.lit("}")), F.coalesce(_paired(n), F.lit(""))))


def signing_key(secret: Column, date: Column, region: Column, service: Column) -> Column:
    key = F.encode(F.concat(F.lit("AWS4"), secret), "UTF-8")
    for part in (date, region, service, F.lit("aws4_request")):
        key = hmac_sha256(key, F.encode(part, "UTF-8"))
    return key


def signed_headers(now: datetime) -> Column:
    """The headers of a signed request (match, headers, body, pairs) at a time."""
    stamp, date = F.lit(f"{now:%Y%m%dT%H%M%SZ}"), F.lit(f"{now:%Y%m%d}")
    secret, token = _paired(F.lit(SIGNING_NAME)), _paired(F.lit(TOKEN_NAME))
    names = F.concat(F.lit("content-type;host;x-amz-date"), F.when(token.isNotNull(), ";x-amz-security-token").otherwise(""))
    lines = F.concat(F.lit("content-type:"), F.col("headers")["content-type"], F.lit("\nhost:"), F.col("headers")["host"], F.lit("\nx-amz-date:"), stamp, F.lit("\n"), F.coalesce(F.concat(F.lit("x-amz-security-token:"), token, F.lit("\n")), F.lit("")))
    whole = F.concat("method", F.lit("\n/\n\n"), lines, F.lit("\n"), names, F.lit("\n"), F.sha2("body", 256))
    scope = F.concat(date, F.lit(f"/{REGION}/{SERVICE}/aws4_request"))
    to_sign = F.concat(F.lit("AWS4-HMAC-SHA256\n"), stamp, F.lit("\n"), scope, F.lit("\n"), F.sha2(whole, 256))
    signature = F.lower(F.hex(hmac_sha256(signing_key(secret, date, F.lit(REGION), F.lit(SERVICE)), F.encode(to_sign, "UTF-8"))))
    said = F.concat(F.lit("AWS4-HMAC-SHA256 Credential="), "match", F.lit("/"), scope, F.lit(", SignedHeaders="), names, F.lit(", Signature="), signature)
    more = F.create_map(F.lit("x-amz-date"), stamp, F.lit("authorization"), said)
    return F.map_concat("headers", F.when(token.isNotNull(), F.map_concat(more, F.create_map(F.lit("x-amz-security-token"), token))).otherwise(more))


def plan(findings: DataFrame, paired: DataFrame, now: datetime | None = None) -> DataFrame:
    """provider, pattern, match, method, url, headers, body, missing: each value once for each provider; ``missing`` says why a request can't be made.

    ``paired`` has one row (``pairs``); ``now`` is the time of signatures, in UTC, this moment if left out.
    """
    now = now or datetime.now(timezone.utc)
    spark = findings.sparkSession
    who = verifier_frame(spark).filter(F.col("provider") != FALLBACK).join(endpoint_frame(spark), "provider")
    rows = findings.select("pattern", "match").distinct().join(F.broadcast(who), "pattern").crossJoin(F.broadcast(paired))  # a row for each provider; one row
    lacks = F.filter("needs", lambda n: _paired(n).isNull())
    missing = F.when(F.size(lacks) > 0, F.concat(F.array_join(lacks, ", "), F.lit(" not found near the value")))
    kind, rest = F.substring_index("sends", " ", 1), F.expr("substring(sends, length(substring_index(sends, ' ', 1)) + 2)")
    head, tail = F.regexp_extract(rest, r"^([^M]*)M", 1), F.regexp_extract(rest, r"^[^M]*M(.*)$", 1)
    basic = F.concat(F.lit("Basic "), F.translate(F.base64(F.encode(F.concat(head, F.col("match"), _filled(tail)), "UTF-8")), "\r\n", ""))
    one = lambda name, value: F.map_concat("headers", F.create_map(name, value))
    headers = F.when(kind == "bearer", one(F.lit("Authorization"), F.concat(F.lit("Bearer "), "match"))).when(kind == "header", one(rest, F.col("match"))).when(kind == "basic", one(F.lit("Authorization"), basic)).otherwise(signed_headers(now))
    told = rows.select("provider", "pattern", "match", "method", _filled(F.col("url")).alias("url"), headers.alias("headers"), "body", missing.alias("missing"))
    made = F.col("missing").isNull()
    return told.select("provider", "pattern", "match", *(F.when(made, F.col(c)).alias(c) for c in ("method", "url", "headers", "body")), "missing")


def unasked(requests: DataFrame) -> DataFrame:
    """Responses (``verify.RESPONSE``) of the requests that can't be made."""
    return requests.filter("missing is not null").select("provider", "match", F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("body"), F.concat(F.lit(MISSING), "missing").alias("error"))


def over_http(method: str, url: str, headers: dict, body: str | None, timeout: float) -> tuple[int | None, str | None, str | None]:
    """Status, body and error of one request."""
    import urllib.error
    import urllib.request

    data = body.encode() if body is not None else b"" if method == "POST" else None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=timeout) as got:
            return got.status, got.read().decode("utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace"), None
    except OSError as e:
        return None, None, str(e)[:SHOWN]


def send(requests: DataFrame, timeout: float = TIMEOUT, concurrency: int = CONCURRENCY, transport=over_http) -> DataFrame:
    """Responses to ``plan`` rows, of which at most ``concurrency`` are under way; those that can't be made are answered here."""

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            got = [transport(r.method, r.url, dict(r.headers), r.body, timeout) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"provider": batch["provider"], "match": batch["match"], "http_status": pd.array([g[0] for g in got], "Int32"), "body": [g[1] for g in got], "error": [g[2] for g in got]})

    asked = requests.filter("missing is null").select("provider", "match", "method", "url", "headers", "body").repartition(concurrency)
    return asked.mapInPandas(run, RESPONSE).union(unasked(requests))
