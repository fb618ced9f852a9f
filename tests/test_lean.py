"""What is kept between steps is small, and costly expressions are computed once."""

import os

import pytest
from pyspark.sql import functions as F

from credsift.operators import rewrite
from credsift.operators.classify import classify, pared
from credsift.operators.scan import scan
from credsift.plans import queries

SF = "/root/testdata/sf0.001"
KEY = "AK" + "IA" + "ABCDEFGHIJKLMNOP"


def kept_bytes(spark) -> int:
    paths = [p.removeprefix("file://") for p in spark.sparkContext._credsift_written]
    return sum(os.path.getsize(f"{p}/{f}") for p in paths for f in os.listdir(p) if f.endswith(".parquet"))


@pytest.mark.parametrize("name", ["classify_ladder", "redacted_view", "baseline_new", "apply_host_verdicts"])
def test_what_is_kept_has_no_context(spark, name):
    spark.sparkContext._credsift_written = []
    n = queries.found(spark, SF).count()
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert n > 1000 and kept_bytes(spark) < 250 * n  # a context of seven lines, sealed twice, took 1,100 a finding


@pytest.mark.parametrize("lines", [False, True])
def test_pared_findings_are_judged_alike(spark, lines):
    texts = [f"key = '{KEY}'  # from_secret", f"x\nkey = '{KEY}'\nsecret_arn {KEY}", f"a\nAPI_KEY = '{KEY}'", "password = \"abcdefgh12345678\"\n" + "z" * 9000]
    found = scan(spark.createDataFrame([(f"app/{i}.rb", t) for i, t in enumerate(texts)], "path string, text string"))
    thin = pared(found, lines)
    rows = lambda d: sorted(map(str, d.collect()))
    some = ["path", "line", "column", "pattern", "step", "verdict", "reason"]
    assert rows(classify(thin).select(*some)) == rows(classify(found).select(*some)) and found.count() >= 4
    assert ("context" in thin.columns) == lines
    if lines:
        assert rows(rewrite.propose(classify(thin), force=True)) == rows(rewrite.propose(classify(found), force=True)) != []


def test_names_of_variables_are_computed_once(spark):
    rows = classify(scan(spark.createDataFrame([("app/a.rb", f"API_KEY = '{KEY}'")], "path string, text string")))
    plan = rewrite.propose(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z][A-Z0-9_]+") == 1  # a filter on the new line, pushed below, would compute the name again


def test_diffs_join_texts_once(spark):
    plan = queries.diffs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1


def test_rewritten_holds_both_texts(spark):
    text = f"API_KEY = '{KEY}'\r\nend\r\n"
    files = spark.createDataFrame([("app/a.rb", text), ("app/b.rb", "x")], "path string, text string")
    rows = classify(scan(files))
    row = rewrite.rewritten(files, rows).first()
    assert row.before == text and row.text == "API_KEY = ENV.fetch('API_KEY')\nend\n"
    assert rewrite.diffs(rewrite.rewritten(files, rows)).collect() == rewrite.unified_diffs(files, rewrite.apply_rewrites(files, rows)).collect() != []


def test_few_expressions_in_one_pass(spark):
    from credsift.operators import catalog

    entries = [(0, "a", "k", "regex", "^va", "FIXTURE"), (1, "b", "k", "regex", "^val", "HONEYTOKEN"), (2, "c", "k", "exact", "value-2", "KNOWN_LEAKED")]
    rows = spark.createDataFrame([(f"value-{i % 3}",) for i in range(9)] + [("other",), (None,)], "match string")
    got = sorted(map(tuple, catalog.lookup(rows, catalog.catalog_frame(spark, entries)).select(F.coalesce("match", F.lit("")), F.coalesce("catalog_id", F.lit(""))).collect()))
    assert got == sorted([("value-0", "a")] * 3 + [("value-1", "a")] * 3 + [("value-2", "c")] * 3 + [("other", ""), ("", "")])


SHARED = ["baseline_merge_initial", "baseline_stats", "baseline_present", "history_events", "org_union", "per_path_groups", "sarif_results", "rewrite_lines", "only_verified", "exit_codes"]


@pytest.mark.parametrize("name", SHARED)
def test_queries_of_judged_findings_keep_little(spark, name):
    spark.sparkContext._credsift_written = []
    n = queries.found(spark, SF).count()
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert 0 < kept_bytes(spark) < 400 * n  # 1,100 a finding and more with contexts


@pytest.mark.parametrize("name", ["classify_ladder", "baseline_merge_initial", "sarif_results", "rewrite_lines"])
def test_findings_are_dealt_once(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where values are many
    try:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt.count("match") == 3 and not {"pattern", "provider", "sha2(cast(match"} & set(dealt)  # findings, values, values that are asked about


def test_an_answer_counts_for_its_patterns_only(spark):
    from credsift.operators import verify

    rows = spark.createDataFrame([("npm_token", "v"), ("slack_token", "v"), ("jwt", "v"), ("npm_token", "w")], "pattern string, match string")
    said = [("npm", "v", 401, "{}", None), ("slack", "v", 200, '{"ok":true}', None), (verify.FALLBACK, "v", 200, "{}", None), ("odd", "w", 200, "{}", None)]
    by = {p: [r.provider for r in verify.verifier_frame(spark).filter(F.col("pattern") == p).collect()] for p in ("npm_token", "slack_token", "jwt")}
    got = {(r.pattern, r.match): (r.provider, r.status) for r in verify.judge(rows, spark.createDataFrame(said, verify.RESPONSE)).collect()}
    assert by["npm_token"] == ["npm", verify.FALLBACK] and got["npm_token", "v"] == (verify.FALLBACK, "verified") and got["npm_token", "w"] == (None, None)
    assert got["slack_token", "v"][1] == ("verified" if by["slack_token"] else None) and got["jwt", "v"] == ((verify.FALLBACK, "verified") if by["jwt"] else (None, None))


def test_lines_are_kept_where_proposals_are_made(spark):
    text = f"API_KEY = '{KEY}'"
    rows = pared(scan(spark.createDataFrame([("app/a.rb", text), ("docs/a.md", text), ("svc/.env", text)], "path string, text string")), lines=True)
    assert {r.path: r.context for r in rows.filter(F.col("match") == KEY).collect()} == {"app/a.rb": [text], "docs/a.md": None, "svc/.env": None}
