"""Owners' repositories, candidates given back by a host, ignored entries, and files that are added to."""

import json

import pytest
from pyspark.sql import functions as F

from credsift.operators import baseline as base
from credsift.operators import rewrite
from credsift.operators.classify import hydrated
from credsift.sources import org
from credsift.sources.ignore_rules import with_entry


def test_repositories_of_an_owner(spark, tmp_path):
    pages = [[{"name": n, "clone_url": f"u/{n}", "fork": n == "f", "archived": n == "a"} for n in ("z", "f", "a")], [{"name": "m", "clone_url": "u/m"}], []]
    rows = org.listed(spark.createDataFrame([(json.dumps(p),) for p in pages], "json string"))
    names = lambda **o: [r.name for r in org.chosen(rows, **o).collect()]
    assert names() == ["m", "z"] and names(forks=True) == ["f", "m", "z"] and names(forks=True, archived=True, most=3) == ["a", "f", "m"]
    for name in ("z/a.rb", "z/.gitignore", "m/a.rb", "m/b.rb", "f/x.rb", "top.rb"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("a.rb\n")
    got = org.checked_out(spark, str(tmp_path), "acme", org.chosen(rows)).collect()
    assert {(r.repo, r.path) for r in got} == {("acme/m", "acme/m/a.rb"), ("acme/m", "acme/m/b.rb")}


def test_candidates_of_a_host_have_defaults(spark):
    given = [{}, {"path": "a", "line": 3, "match_redacted": "AK...", "severity": "odd", "verdict": " Real", "context": ["x", None]}, {"match": "m", "match_redacted": "r", "severity": "high", "confidence": 0.5}]
    rows = hydrated(spark.createDataFrame([(json.dumps(g),) for g in given], "json string")).collect()
    assert [tuple(r) for r in rows] == [("", 1, 1, "", "unknown", "unknown", [], "unknown", None, None), ("a", 3, 1, "AK...", "unknown", "unknown", ["x"], "real", None, None), ("", 1, 1, "m", "unknown", "high", [], "unknown", None, 0.5)]


def test_an_entry_is_marked_as_ignored(spark):
    rows = spark.createDataFrame([("f1", "jwt", "x", "active", None, None, 1, True, "a", 1), ("f2", "jwt", "x", "active", None, None, 1, True, "a", 1)], base.SCHEMA)
    assert {r.fingerprint: r.status for r in base.mark_ignored(rows, "f2").collect()} == {"f1": "active", "f2": "ignored"}
    with pytest.raises(KeyError):
        base.mark_ignored(rows, "f3")


def test_entries_of_ignore_files():
    assert with_entry("", ".salt") == ".salt\n" and with_entry("a", ".salt") == "a\n.salt\n" and with_entry("a\n .salt \n", ".salt") == "a\n .salt \n"


def test_example_files_grow(spark, tmp_path):
    path = tmp_path / ".env.example"
    lines = lambda *names: spark.createDataFrame([(f"{n}=", n) for n in names], "env_example_line string, env_var string")
    rewrite.write_env_example(lines(), str(path))
    assert not path.exists()
    rewrite.write_env_example(lines("B_KEY", "A_KEY", "A_KEY"), str(path))
    assert path.read_text() == "# Added by credsift:\nA_KEY=\nB_KEY=\n"
    path.write_text("OWN=1\nA_KEY=")
    rewrite.write_env_example(lines("A_KEY", "C_KEY"), str(path))
    assert path.read_text() == "OWN=1\nA_KEY=\n# Added by credsift:\nC_KEY=\n"


def test_a_proposal_may_be_forced(spark):
    rows = spark.createDataFrame([("app/a.rb", 1, 1, "jwt", "value-value-value", ["KEY = 'value-value-value'"], "fixture")], "path string, line int, column int, pattern string, match string, context array<string>, verdict string")
    assert rewrite.propose(rows).count() == 0 and [r.env_var for r in rewrite.propose(rows, force=True).collect()] == ["KEY"]
