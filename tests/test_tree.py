"""Walking a tree: which files are read, by nested ignore files, names, globs and lists."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from credsift.sources.files import glob_regex, normalised, read_file, read_files, scannable, walk
from credsift.sources.ignore_rules import decided, global_rules, parsed_rule, rule_lines


def put(root, **files):
    for name, text in files.items():
        write(root, name, text)


def write(root, name, text=""):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def names(rows):
    return {r.path for r in rows.select("path").collect()}


def test_kinds_of_files(spark, tmp_path):
    for name in ("a.rb", "b.png", ".env.local", "sub/.env", ".claude/mcp.json", ".claude/worktrees/copy/dup.rb", ".github/w.yml", "_x/y.py", "no_extension", "sp ace/ü%20.rb"):
        write(tmp_path, name, "x")
    os.symlink(tmp_path / "a.rb", tmp_path / "link.rb")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    want = {"a.rb", ".env.local", "sub/.env", ".claude/mcp.json", ".github/w.yml", "_x/y.py", "sp ace/ü%20.rb"}
    assert names(read_files(spark, str(tmp_path))) == want == names(read_files(spark, f"file://{tmp_path}/"))
    assert [r.text for r in read_file(spark, str(tmp_path / "no_extension")).collect()] == ["x"] and not read_file(spark, str(tmp_path / "none")).collect()


def test_ignore_files_by_folder_and_kind(spark, tmp_path):
    rules = {
        ".gitignore": "ignored.rb\n*.txt\n!keep.txt\n/build/\nlogs/**\n# note\n\\#odd.rb\nspaced.rb   \n",
        "lib/.gitignore": "!ignored.rb\nx.rb\n", "build/.gitignore": "!*\n", "lib/.ignore": "!y.txt\n", ".git/info/exclude": "*.md\n", "deep/a/.gitignore": "/b/*.rb\n!/b/c.rb",
    }
    kept = {"kept.rb", "lib/ignored.rb", "keep.txt", "lib/y.txt", "deep/a/b/c.rb", "deep/b/x.rb", "build.rb", "sub/build/z.rb"}
    gone = {"ignored.rb", "a.txt", "lib/x.rb", "build/x.rb", "logs/x.rb", "#odd.rb", "spaced.rb", "r.md", "deep/a/b/x.rb", "sub/ignored.rb", "lib/z.txt"}
    for name in kept | gone:
        write(tmp_path, name, "x")
    for name, text in rules.items():
        write(tmp_path, name, text)
    assert names(read_files(spark, str(tmp_path))) == kept
    assert names(read_files(spark, str(tmp_path), use_ignore_files=False)) == kept | gone
    assert names(read_files(spark, str(tmp_path), ignore_rules=("lib/", "!r.md"))) == kept - {"lib/ignored.rb", "lib/y.txt"}


def test_rules_equal_those_of_git(spark, tmp_path):
    rnd = random.Random(3)
    parts = ["a", "b", "ab", "a.rb", "b.rb", "x y", "c[1].rb", "build", "é"]
    globs = ["a", "*.rb", "/a", "a/", "b/*", "**/ab", "a/**", "a/**/b.rb", "!b.rb", "!a", "?", "[ab]", "[!a]*", "a*/", "!/b/", "c\\[1\\].rb", "*", "!*/", "x y", "#no", "\\!x", "ab/b", "[[]", "é", "**", "/*/a", "a**b"]
    for tree in range(6):
        root = tmp_path / str(tree)
        root.mkdir()
        subprocess.run(["git", "init", "-q"], cwd=root, check=True)
        for _ in range(60):
            try:
                write(root, "/".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))), "x")
            except (FileExistsError, NotADirectoryError, IsADirectoryError):
                pass
        for folder in [root, *(d for d in sorted(root.rglob("*")) if d.is_dir() and ".git" not in d.parts and rnd.random() < 0.3)]:
            write(folder, ".gitignore", "\n".join(rnd.choice(globs) for _ in range(rnd.randrange(1, 5))))
        write(root, ".git/info/exclude", "build\n!ab")
        done = subprocess.run(["git", "-c", "core.excludesFile=/dev/null", "-c", "core.quotePath=false", "ls-files", "-o", "-z", "--exclude-standard"], cwd=root, check=True, capture_output=True)
        want = {p for p in done.stdout.decode().split("\0") if p}
        every = walk(spark, str(root)).filter(~F.col("path").startswith(".git/"))
        texts = spark.createDataFrame([(str(p.relative_to(root)), p.read_text()) for p in [*root.rglob(".gitignore"), root / ".git/info/exclude"]], "path string, text string")
        rows = decided(every, rule_lines(texts)).collect()
        assert {r.path for r in rows if not r.ignored} == want, tree
        assert all((r.decided_at is not None and (r.path == r.decided_at or r.path.startswith(r.decided_at + "/"))) == r.ignored for r in rows)


def test_lines_that_are_no_rules():
    assert [parsed_rule(x) for x in ("", "  ", "# x", "/", "!", "[", "a\\", "[z-a]")] == [None] * 8
    assert parsed_rule("!dir/ ") == ("^(?:.*/)?dir$", True, True) and parsed_rule("a\\ ")[0] == "^(?:.*/)?a\\ $"


def test_no_rules_and_no_files(spark):
    none = spark.createDataFrame([], "path string")
    some = spark.createDataFrame([("a/b.rb",), ("a/b.rb",)], "path string")
    assert decided(none, global_rules(spark, "*")).collect() == [] and [tuple(r) for r in decided(some, global_rules(spark)).collect()] == [("a/b.rb", False, None, None)]
    assert [tuple(r) for r in decided(some, global_rules(spark, "a")).collect()] == [("a/b.rb", True, "a", "a")]


@pytest.mark.parametrize("bad", ["[", "a/[b", "x\\", "[z-a]"])
def test_a_bad_exclude_glob_is_an_error(bad):
    with pytest.raises(ValueError):
        scannable(F.lit("a"), (bad,))


def test_exclude_globs(spark):
    match = lambda glob, path: spark.range(1).select(F.lit(path).rlike(glob_regex(glob))).first()[0]
    for glob, path, want in [("vendor/**", "vendor/a.rb", True), ("vendor", "x/vendor/a.rb", True), ("/vendor", "x/vendor/a.rb", False), ("*.min.js", "a/b.min.js", True), ("a/**/c", "a/c", True), ("a/*", "a/b/c", True), ("a?c", "a/c", False), ("[!x]y", "/y", False)]:
        assert match(glob, path) == want, (glob, path)


def test_paths_to_keep_to(spark, tmp_path):
    write(tmp_path, "a.rb", "x")
    write(tmp_path, "sub/b.rb", "y")
    only = spark.createDataFrame([("./sub/../a.rb",), ("sub//./b.rb",), ("../../none.rb",)], "path string")
    assert names(read_files(spark, str(tmp_path), only=only)) == {"a.rb", "sub/b.rb"}
    assert [r[0] for r in only.select(normalised(F.col("path"))).collect()] == ["a.rb", "sub/b.rb", "none.rb"]
