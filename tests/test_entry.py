"""The driver's contract, and the registered queries against their SQL on the smallest tables."""

import importlib.util
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["doc_lines", "path_filter", "pattern_dim", "verifier_dim", "patterns_without_verifier", "git_added_lines", "pragma_rows", "classify_ladder", "scan_corpus_all_patterns", "stream_scan", "ignored_paths", "verification_requests", "findings_in_order", "apply_host_verdicts", "prompt_candidates", "history_events"]


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", SOME + ["op5_segment_partition", "op11_merkle_manifest", "op12_drake_centroids", "op13_count_vector_rtree"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if name not in entry.queries():
        pytest.skip("not registered")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda some, names: sorted(repr([value(r[i]) for i in sorted(range(len(names)), key=names.__getitem__)]) for r in some)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    if importlib.util.find_spec("credsift.llm") is not None:
        assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_windows_of_detections(spark):
    from credsift.streaming.stream import detections_by_window

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "ts string, pattern string").selectExpr("cast(ts as timestamp) ts", "pattern")
    assert sorted(r.n for r in detections_by_window(rows).collect()) == [1, 2]
