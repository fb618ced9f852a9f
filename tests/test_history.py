"""Histories: which commits are read and how, patches against a parser line by line, and lines of any length."""

import random
import re
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from credsift.functions.patterns import patterns
from credsift.operators.scan import extract, scan_history
from credsift.sources import git_source
from credsift.sources.git_patch import added_lines, hunks, new_history, read_history

KEY = "AK" + "IA" + "Q3EGRIBC7XW2JH5T"
OTHER = "AK" + "IA" + "ZZEGRIBC7XW2JH5T"


class Repo:
    def __init__(self, path):
        self.path = str(path)
        path.mkdir(exist_ok=True)
        self.git("init", "-q", "-b", "main")

    def git(self, *words):
        return subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *words], cwd=self.path, check=True, capture_output=True, text=True).stdout.strip()

    def put(self, name, text, subject):
        file = __import__("pathlib").Path(self.path, name)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        self.git("add", "-A")
        self.git("commit", "-qm", subject)
        return self.git("rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    return Repo(tmp_path / "one")


def found(rows):
    return sorted((r.sha, r.path, r.line, r.match) for r in rows.collect())


def test_a_key_is_reported_at_the_commit_that_added_it(spark, repo):
    repo.put("app/config.rb", "a\nb\n", "base")
    added = repo.put("app/config.rb", f"a\nkey = '{KEY}'\nb\n", "add key")
    repo.put("app/config.rb", "a\nb\n", "remove key")
    assert found(scan_history(read_history(spark, repo.path))) == [(added, "app/config.rb", 2, KEY)]
    repo.put("app/config.rb", f"a\nkey = '{KEY}'\nb\n", "again")
    repo.put("app/config.rb", f"a\nkey = '{KEY}'\nb\nc\n", "touch")
    assert len(found(scan_history(read_history(spark, repo.path)))) == 2


def test_ranges_refs_paths_and_counts(spark, repo):
    first = repo.put("a.rb", f"'{KEY}'\n", "one")
    second = repo.put("lib/b.rb", f"'{OTHER}'\n", "two")
    repo.git("checkout", "-qb", "side")
    third = repo.put("side.rb", f"\n'{KEY}'\n", "three")
    repo.git("checkout", "-q", "main")
    scan = lambda **o: found(scan_history(read_history(spark, repo.path, **o)))
    assert scan(since="HEAD~1") == [(second, "lib/b.rb", 1, OTHER)]
    assert scan(until=first) == [(first, "a.rb", 1, KEY)]
    assert {r[0] for r in scan()} == {first, second} and {r[0] for r in scan(all_refs=True)} == {first, second, third}
    assert scan(paths=("lib",)) == [(second, "lib/b.rb", 1, OTHER)] == scan(max_count=1)
    assert scan(since="HEAD") == []


def test_a_revision_is_no_option(spark, repo, tmp_path):
    repo.put("a.rb", "x\n", "one")
    out = tmp_path / "made"
    for bad in (f"--output={out}", "HEAD~9", "-p", "none"):
        with pytest.raises(Exception, match="does not exist"):
            read_history(spark, repo.path, until=bad).collect()
        with pytest.raises(ValueError):
            git_source.commits(repo.path, since=bad)
    assert not out.exists()


def test_many_commits_are_many_partitions_of_several_repositories(spark, repo, tmp_path, monkeypatch):
    other = Repo(tmp_path / "two words")
    ids = {repo.path: [repo.put("é.rb", f"{i}\n", f"c{i}") for i in range(7)], other.path: [other.put("x.rb", f"{i}\n", "\x02 odd") for i in range(2)]}
    monkeypatch.setattr(git_source, "COMMITS", 3)
    reader = git_source.HistoryReader(git_source.GitHistory.options_of([repo.path, other.path]))
    parts = reader.partitions()
    assert [len(p.ids) for p in parts] == [3, 3, 1, 2]
    rows = [row for p in parts for row in reader.read(p)]
    assert [(r, s) for r, s, _ in rows] == [(repo.path, i + 1) for i in range(7)] + [(other.path, 1), (other.path, 2)]
    assert [p.split("\x1f")[0] for _, _, p in rows] == ids[repo.path][::-1] + ids[other.path][::-1]
    assert {r.path for r in hunks(read_history(spark, repo.path, other.path)).select("path").collect()} == {"é.rb", "x.rb"}


def test_patches_come_whole_in_any_chunk(repo, monkeypatch):
    ids = [repo.put(f"f{i}.rb", "é" * 3000 + "\n", "s") for i in range(4)]
    whole = list(git_source.patches(repo.path, ids, [], 3))
    monkeypatch.setattr(git_source, "CHUNK", 7)
    assert list(git_source.patches(repo.path, ids, [], 3)) == whole and len(whole) == 4 and all("é" * 3000 in p for p in whole)


def test_new_commits_come_as_a_stream(spark, repo, tmp_path):
    first = repo.put("a.rb", f"'{KEY}'\n", "one")
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        query = new_history(spark, repo.path).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
        return found(scan_history(spark.read.parquet(out)))

    assert [r[0] for r in run()] == [first]
    second = repo.put("b.rb", f"'{OTHER}'\n", "two")
    assert {r[0] for r in run()} == {first, second}


def parsed(text):
    """Added lines by a parser that goes line by line."""
    out, sha, path, at = [], None, None, 0
    for line in text.split("\n"):
        if line.startswith("\x01"):
            sha, path, at = line[1:].split("\x1f")[0], None, 0
        elif line.startswith("diff --git "):
            path, at = None, 0
        elif at == 0 and line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else None
        elif line.startswith("@@"):
            at = int(re.search(r"\+(\d+)", line)[1])
        elif path and at and line[:1] in ("+", " "):
            if line[0] == "+":
                out.append((sha, path, at, line[1:].removesuffix("\r")))
            at += 1
    return out


def test_patches_equal_a_parser_line_by_line(spark, repo):
    rnd = random.Random(2)
    lines = ["++ b/trick", "-- a/x", "@@ -1 +1 @@", "diff --git a/x b/x", " lead", "", "plain", "tail\r", "é"]
    kept = {}
    for n in range(12):
        for name in rnd.sample(["a.rb", "b b.rb", "é/c.rb", "+++ b.rb"], 2):
            text = kept.setdefault(name, [])
            for _ in range(rnd.randrange(1, 30)):
                text.insert(rnd.randrange(len(text) + 1), rnd.choice(lines))
            if rnd.random() < 0.3:
                del text[: rnd.randrange(len(text))]
            file = __import__("pathlib").Path(repo.path, name)
            file.parent.mkdir(exist_ok=True)
            file.write_text("\n".join(text))
        repo.git("add", "-A")
        repo.git("commit", "-qm", f"c{n} @@ \x1f", "--allow-empty")
    commits = read_history(spark, repo.path)
    want = [row for r in commits.collect() for row in parsed("\x01" + r.patch)]
    rows = added_lines(commits).collect()
    assert sorted((r.sha, r.path, r.line, r.text) for r in rows) == sorted(want) and len(want) > 100
    assert all(r.text in r.context and len(r.context) <= 7 for r in rows)
    plan = added_lines(commits)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("unit", ["postgres" + "://u:", "-eyJ", '"type":"service_account"', "redis" + "://:", "mongodb" + "://a:b@", "x" * 7 + "password = '"])
def test_a_long_line_takes_seconds(spark, unit):
    text = unit * ((2 << 20) // len(unit))
    commits = spark.createDataFrame([("r", 1, f"s\x1fsubject\ndiff --git a/x b/x\n+++ b/x\n@@ -0,0 +1,2 @@\n+{text}\n+{KEY} {text}")], "repo string, seq int, patch string")
    began = time.time()
    rows = scan_history(commits, context=0).filter(F.col("pattern") == "aws_access_key").select("line", "column").collect()
    assert [(r.line, r.column) for r in rows] == [(2, 1)] and time.time() - began < 60


def test_reading_in_vain_loses_nothing(spark):
    rnd = random.Random(5)
    rows = [p for p in patterns() if p.consuming]
    bits = ["postgres" + "://", "mysql" + "://", "mongodb+srv" + "://", "redis" + "://", "u", ":", "@", "p4ss", "h.x", " ", "'", "-", "é", "eyJ", "abcdefghijk", ".", '"type": "service_account"', '"private_key_id":"', "0a" * 20, '"', "}", "{"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(2, 25))) for _ in range(4_000)]
    texts += [f"{a}eyJ{'b' * 12}.eyJ{'c' * 12}.{'d' * 12}{z}" for a in ("", "-eyJ", "eyJ-") for z in ("", "-", ".eyJ")]
    got = {}
    for r in extract(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), tuple(rows)).collect():
        got.setdefault((r.i, r.pattern), []).append((r.column, r.match))
    want = {}
    for i, text in enumerate(texts):
        for p in rows:
            hits = [(len(text[: m.start(1)].encode()) + 1, m[1]) for m in re.finditer(p.regex, text)]
            if hits:
                want[i, p.id] = hits
    assert got == want and len({k[1] for k in want}) == 6
