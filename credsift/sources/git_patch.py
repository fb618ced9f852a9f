"""Commit histories: the text of ``git log -p`` as rows of hunks and of added lines.

A patch is cut into its files and a file into its hunks, so a large commit is many small rows; within a hunk, lines of the new
file are counted by their place in an array. Nothing is sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .git_source import COMMIT, FIELD, GitHistory

CONTEXT_LINES = 3


def read_history(spark: SparkSession, *repositories: str, since: str | None = None, until: str | None = None, all_refs: bool = False, max_count: int | None = None, paths: tuple[str, ...] = (), context: int = CONTEXT_LINES) -> DataFrame:
    """repo, seq, patch: one row for each commit of repositories in a folder that driver and executors see."""
    return spark.read.format(GitHistory.ready(spark)).options(**GitHistory.options_of(repositories, since, until, all_refs, max_count, paths, context)).load()


def new_history(spark: SparkSession, *repositories: str, paths: tuple[str, ...] = (), context: int = CONTEXT_LINES) -> DataFrame:
    """The same as a stream: all commits of HEAD first, then those that come."""
    return spark.readStream.format(GitHistory.ready(spark)).options(**GitHistory.options_of(repositories, paths=paths, context=context)).load()


def split_commits(patches: DataFrame) -> DataFrame:
    """repo, seq, patch from repo, text."""
    return patches.select("repo", F.posexplode(F.split("text", COMMIT)).alias("seq", "patch")).filter(F.length("patch") > 0)


def hunks(commits: DataFrame) -> DataFrame:
    """repo, seq, sha, subject, path, first (line of the new file), lines (of the new file, each after ``+`` or a blank).

    Deleted files and quoted paths have no path and are dropped. Only what precedes a file's first hunk names it: an added line
    may start with ``++ b/``.
    """
    head = F.substring_index("patch", "\n", 1)
    files = commits.select("repo", "seq", F.substring_index(head, FIELD, 1).alias("sha"), F.substring_index(head, FIELD, -1).alias("subject"), F.explode(F.split("patch", "\n(?=diff --git )")).alias("file"))
    parts = files.select("repo", "seq", "sha", "subject", F.split("file", "\n(?=@@)").alias("parts")).filter(F.size("parts") > 1)
    path = F.nullif(F.regexp_extract(F.get("parts", F.lit(0)), r"(?m)^\+\+\+ b/(.*)$", 1), F.lit(""))
    rows = parts.withColumn("path", path).filter("path is not null")
    rows = rows.select("repo", "seq", "sha", "subject", "path", F.explode(F.slice("parts", 2, F.size("parts"))).alias("hunk"))
    first = F.regexp_extract(F.substring_index("hunk", "\n", 1), r"^@@[^+]*\+(\d+)", 1)
    lines = F.filter(F.split("hunk", "\n"), lambda x: x.startswith("+") | x.startswith(" "))
    return rows.select("repo", "seq", "sha", "subject", "path", F.nullif(first, F.lit("")).cast("int").alias("first"), lines.alias("lines")).filter("first > 0")


def _text(line: Column) -> Column:
    return F.regexp_replace(F.substring(line, F.lit(2), F.length(line)), r"\r$", "")


def at_lines(rows: DataFrame, at: Column, context: int | None = CONTEXT_LINES) -> DataFrame:
    """The lines of ``hunks`` rows at places (an array): repo, seq, sha, subject, path, line, text and, unless None, context."""

    def row(i: Column) -> Column:
        fields = [(F.col("first") + i).alias("line"), _text(F.get("lines", i)).alias("text")]
        if context is not None:
            window = F.slice("lines", F.greatest(i - context, F.lit(0)) + 1, F.least(i, F.lit(context)) + context + 1)
            fields.append(F.transform(window, _text).alias("context"))
        return F.struct(*fields)

    return rows.select("repo", "seq", "sha", "subject", "path", F.inline(F.transform(at, row)))


def added_lines(commits: DataFrame, context: int | None = CONTEXT_LINES) -> DataFrame:
    """repo, seq, sha, subject, path, line, text, context: lines that a commit adds, numbered in the new file."""
    at = F.filter(F.transform("lines", lambda x, i: F.when(x.startswith("+"), i)), lambda i: i.isNotNull())
    return at_lines(hunks(commits), at, context)


def path_allowed(path: Column, paths: list[str]) -> Column:
    """Equal to one of ``paths``, or below it."""
    out = F.lit(not paths)
    for p in paths:
        p = p.rstrip("/")
        out = out | (path == p) | path.startswith(p + "/")
    return out
