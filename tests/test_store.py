"""What is kept between runs: versions of a baseline, batches merged once, state by fingerprint, and no raw value in any file."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from credsift.functions import text as fn
from credsift.operators import baseline as base
from credsift.operators import report, rewrite
from credsift.operators.classify import classify
from credsift.operators.scan import numbered, scan
from credsift.sources import store, versions
from credsift.streaming import stream

KEY = "AK" + "IA" + "Q3EGRIBC7XW2JH5T"
FOUND = "ts timestamp, fingerprint string, path string, line int, column int, pattern string, pattern_ord int, match string, status string, verdict string"


def entries(spark, *some):
    return spark.createDataFrame([(f, "jwt", "eyJ***", status, None, None, 1, True, "a.py", 3) for f, status in some], base.SCHEMA)


def test_a_baseline_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "base line")
    assert base.read_baseline(spark, where).collect() == []
    base.write_baseline(entries(spark, ("f1", "active")), where)
    pinned = base.read_baseline(spark, where)
    for step in ("table", "pointer"):
        if step == "table":
            bad = entries(spark, ("f2", "active")).withColumn("kind", F.raise_error(F.lit("lost")).cast("string"))
        else:
            bad = entries(spark, ("f3", "active"))
            monkeypatch.setattr(versions, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception):
            base.write_baseline(bad, where)
        assert [r.fingerprint for r in base.read_baseline(spark, where).collect()] == ["f1"]
    monkeypatch.undo()
    base.write_baseline(entries(spark, ("f4", "active"), ("f0", "rotated")), where)
    assert [r.fingerprint for r in base.read_baseline(spark, where).collect()] == ["f0", "f4"] and [r.fingerprint for r in pinned.collect()] == ["f1"]


def test_older_versions_go(spark, tmp_path):
    where = str(tmp_path / "b")
    for n in range(5):
        base.write_baseline(entries(spark, (f"f{n}", "active")), where)
    assert len(list((tmp_path / "b/versions").iterdir())) == 3 and len(versions.current(spark, where)["older"]) == 2
    assert [r.fingerprint for r in base.read_baseline(spark, where).collect()] == ["f4"]


def test_json_baselines_and_history(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"entries":{"f1":{"kind":"jwt","status":"active","first_line":3}}}')
    assert [(r.fingerprint, r.kind, r.first_line) for r in base.read_baseline(spark, str(tmp_path / "b.json")).collect()] == [("f1", "jwt", 3)]
    rows = spark.createDataFrame([("f1", "a.py", 3, "verified", "npm", "c0ffee"), ("f2", "b.py", 1, None, None, "beef")], "fingerprint string, path string, line int, status string, provider string, sha string")
    events = base.history_events(rows, "2024-01-01 00:00:00")
    for _ in range(2):
        base.append_history(events, str(tmp_path / "history"))
    got = base.read_history(spark, str(tmp_path / "history"))
    assert sorted(map(str, got.collect())) == sorted(map(str, events.collect() * 2)) and {r.commit for r in got.collect()} == {"c0ffee", "beef"}


def random_findings(seed, n=120):
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(start + timedelta(minutes=i), f"f{rnd.randrange(20)}", f"p{i:04}", i, 1, "jwt", 1, "value", rnd.choice(["verified", "invalid", None]), rnd.choice(["fixture", "real", "unknown"])) for i in range(n)]


def in_batches(spark, rows, folder, size):
    for n in range(0, len(rows), size):
        spark.createDataFrame(rows[n : n + size], FOUND).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(folder)


def test_batches_of_a_stream_equal_sequential_merges(spark, tmp_path):
    rows = random_findings(1)
    where = str(tmp_path / "b")
    source = in_batches(spark, rows, str(tmp_path / "in"), 30)
    stream.merge_stream(source, where, "2024-02-02 00:00:00").awaitTermination()
    want = spark.createDataFrame([], base.SCHEMA)
    for n in range(0, len(rows), 30):
        want = base.merge(want, spark.createDataFrame(rows[n : n + 30], FOUND), "2024-02-02 00:00:00")
    assert sorted(base.read_baseline(spark, where).collect()) == sorted(want.collect())
    batch = versions.current(spark, where)["batch"]
    assert batch == 3 and base.write_baseline(entries(spark, ("again", "active")), where, batch) is False
    stream.merge_stream(in_batches(spark, rows[:5], str(tmp_path / "in"), 5), where, "2024-03-03 00:00:00").awaitTermination()
    assert versions.current(spark, where)["batch"] == 4
    counts = {r.fingerprint: r.verification_attempts for r in base.read_baseline(spark, where).collect()}
    assert sum(counts.values()) == len(rows) + 5


def test_state_by_fingerprint_follows_the_same_rule(spark, tmp_path):
    rows = random_findings(2)
    source = in_batches(spark, rows, str(tmp_path / "in"), 40)
    out = str(tmp_path / "out")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream.rolling_baseline(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    last = {r.fingerprint: (r.s.status, r.s.verification_attempts, r.s.ever_verified) for r in spark.read.parquet(out).groupBy("fingerprint").agg(F.max_by(F.struct("status", "verification_attempts", "ever_verified"), "batch").alias("s")).collect()}
    want = {}
    for _, f, *_, status, verdict in rows:
        s, n, ever = want.get(f, ("active", 0, False))
        s, ever = ("active", True) if status == "verified" else ("rotated", True) if ever else ("fixture" if verdict == "fixture" else s, False)
        want[f] = (s, n + 1, ever)
    assert last == want


def test_a_verified_value_that_is_seen_no_more_is_rotated_by_a_timer(spark, tmp_path):
    day = lambda d, f, status: (datetime(2024, 1, d), f, "p", 1, 1, "jwt", 1, "v", status, "real")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    source = in_batches(spark, [day(1, "old", "verified"), day(9, "x", None), day(10, "x", None), day(11, "x", None)], folder, 1)

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream.rolling_baseline(source, quiet=timedelta(days=2)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    got = [r.status for r in spark.read.parquet(out).filter("fingerprint = 'old'").orderBy("batch").collect()]
    assert got == ["active", "rotated"]


def test_no_raw_value_reaches_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda s: f"file://{tmp_path}/kept")
    monkeypatch.setattr(stream, "shared_dir", lambda s: f"file://{tmp_path}/streams")
    files = spark.createDataFrame([("app/a.rb", f"x\nAPI_KEY = '{KEY}'\ny {KEY}"), ("b.rb", "none")], "path string, text string")
    plain = scan(files)
    rows = classify(store.written_sealed(plain, "findings").withColumn("fingerprint", fn.fingerprint(F.col("match"), b"salt" * 8)))
    assert sorted(map(str, store.written_sealed(plain, "again").collect())) == sorted(map(str, plain.collect())) and plain.count() == 3
    assert [r.id for r in numbered(rows).orderBy("id").collect()] == [0, 1, 2]
    report.write_sarif(rows, str(tmp_path / "report"))
    base.write_baseline(base.merge(spark.createDataFrame([], base.SCHEMA), rows, "2024-01-01"), str(tmp_path / "baseline"))
    base.append_history(base.history_events(rows, "2024-01-01"), str(tmp_path / "history"))
    report.finding_view(rows).write.json(str(tmp_path / "view"))
    rewrite.propose(rows).write.json(str(tmp_path / "proposals"))
    spark.createDataFrame([(1, f"key = {KEY}")], "doc_id long, text string").write.parquet(str(tmp_path / "input"))
    assert [r.match for r in stream.scan_available(spark, str(tmp_path / "input")).collect()] == [KEY]
    seen = 0
    for f in tmp_path.rglob("*"):
        if f.is_file() and tmp_path / "input" not in f.parents:
            seen += 1
            assert KEY.encode() not in f.read_bytes(), f
    assert seen > 20 and any((tmp_path / "kept").iterdir())
    store.discard(spark)
    assert not any((tmp_path / "kept").iterdir())


def test_order_is_numbered_without_gaps(spark):
    rnd = random.Random(9)
    rows = [(f"{rnd.choice('ab/')}/{rnd.choice('-/.x')}{i % 7}", rnd.randrange(9), rnd.randrange(3), "m", "jwt", i % 4, "high", ["c"]) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "path string, line int, column int, match string, pattern string, pattern_ord int, severity string, context array<string>").repartition(7)).collect()
    assert sorted(r.id for r in got) == list(range(500))
    keys = [(r.path.split("/"), r.line, r.column, r.pattern_ord) for r in sorted(got, key=lambda r: r.id)]
    assert keys == sorted(keys)
