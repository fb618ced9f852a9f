"""One document a run, and catalogues of many expressions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from credsift.operators import catalog, report

FINDING = "path string, line int, column int, match string, pattern string, pattern_ord int, severity string, context array<string>, verdict string, confidence double"


def findings(spark, n):
    rows = spark.range(n).select(
        F.concat(F.lit('d"ir/f'), (F.col("id") * 7919 % n).cast("string"), F.lit(".rb")).alias("path"), (F.col("id") % 50 + 1).cast("int").alias("line"), F.lit(1).alias("column"),
        F.concat(F.lit("secret-é-value-"), F.col("id").cast("string")).alias("match"), F.lit("jwt").alias("pattern"), F.lit(3).alias("pattern_ord"), F.lit("high").alias("severity"),
        F.array(F.lit("x")).alias("context"), F.when(F.col("id") % 3 == 0, "fixture").otherwise("real").alias("verdict"), F.lit(0.5).alias("confidence"),
    )
    return spark.createDataFrame(rows.rdd, FINDING) if n == 0 else rows


@pytest.mark.parametrize("n", [0, 1, 5, 20_000])
def test_documents_are_whole_and_in_order(spark, tmp_path, n):
    rows = findings(spark, n)
    report.write_json(rows, str(tmp_path / "a.json"))
    report.write_json(rows.filter("false"), str(tmp_path / "b.json"))
    report.write_sarif_document(rows, str(tmp_path / "a.sarif"), show_fixtures=False)
    listed = json.loads((tmp_path / "a.json").read_text())
    assert len(listed) == n and json.loads((tmp_path / "b.json").read_text()) == []
    assert [(r["path"].split("/"), r["line"]) for r in listed] == sorted((r["path"].split("/"), r["line"]) for r in listed)
    sarif = json.loads((tmp_path / "a.sarif").read_text())
    results = sarif["runs"][0]["results"]
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["tool"]["driver"]["rules"]) == 62 and len(results) == sum(r["verdict"] != "fixture" for r in listed)
    assert all(r["properties"]["git_commit"] is None and r["level"] == "error" and "value" not in r["message"]["text"] for r in results)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a.json", "a.sarif", "b.json"]


def test_documents_of_histories_name_commits(spark, tmp_path):
    report.write_sarif_document(findings(spark, 2).withColumn("sha", F.lit("c0ffee")).withColumn("subject", F.lit("s \"q")), str(tmp_path / "h.sarif"))
    assert {(r["properties"]["git_commit"], r["properties"]["git_commit_subject"]) for r in json.loads((tmp_path / "h.sarif").read_text())["runs"][0]["results"]} == {("c0ffee", "s \"q")}


@pytest.mark.parametrize("regex, want", [
    ("^abcdef", ["abcdef"]), ("ab", []), ("(?i)abcdef", []), ("a(?i:bcdef)", []), ("x?abc[0-9]+longer", ["longer"]), ("(abc|defg)", ["abc", "defg"]),
    (r"://(?:user|name)@", ["user", "name"]), ("\\p{Lu}abc", []), ("a{3}", []), ("(?:tok_en)?zzz", ["zzz"]),
])
def test_required_texts(regex, want):
    assert catalog.required_texts(regex) == want


def test_many_expressions(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdef012") for _ in range(n))
    rules = [f"^https://{word(9)}" for _ in range(99_000)] + [f"{word(2)}[0-9]{{2}}$" for _ in range(400)] + [f"(?i){word(6)}" for _ in range(300)] + [f"{word(3)}.*(?:{word(6)}|{word(5)})" for _ in range(300)]
    values = [f"https://{rule[9:15]}{word(3)}" for rule in rnd.sample(rules[:99_000], 40)] + [rule[1:] + "x" for rule in rnd.sample(rules[:99_000], 40)] + [word(9) for _ in range(60)] + ["ab", "", word(12).upper()]
    values += [f"{r[:3]}..{r[-6:-1]}" for r in rules[-20:]]
    entries = spark.createDataFrame([(i, f"r{i}", "k", "regex", r, "FIXTURE") for i, r in enumerate(rules)], catalog.SCHEMA)
    got = {r.match: r.catalog_id for r in catalog.lookup(spark.createDataFrame([(v,) for v in values], "match string"), entries).collect()}
    compiled = [(i, re.compile(r)) for i, r in enumerate(rules) if not r.startswith("^")]
    for v in set(values):
        first = [i for i, r in compiled if r.search(v)] + [i for i, r in enumerate(rules[:99_000]) if v.startswith(r[1:])]
        assert got[v] == (f"r{min(first)}" if first else None), v
    assert sum(v is not None for v in got.values()) > 40


def test_catalogues_in_order_of_preference(spark, tmp_path):
    entry = lambda name: {"entries": [{"id": name, "kind": "k", "match": {"strategy": "exact", "value": "v"}, "source": "s", "trust": "t", "verdict": "FIXTURE"}]}
    refreshed, own = tmp_path / "latest.json", tmp_path / "own.json"
    ids = lambda *paths: [r.id for r in catalog.read_chain(spark, *paths).collect()]
    own.write_text(json.dumps(entry("own")))
    assert ids(str(refreshed), str(own)) == ["own"] and len(ids(str(refreshed), None)) == 8
    refreshed.write_text(json.dumps(entry("new")))
    assert ids(str(refreshed), str(own)) == ["new"]
    refreshed.write_text('{"entries":[{"id":"broken"}]}')
    with pytest.raises(ValueError):
        ids(str(refreshed), str(own))
