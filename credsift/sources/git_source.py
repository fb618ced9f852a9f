"""A data source of commit histories: ids of commits are listed once, their patches are read by the executors.

Repositories lie in a folder that all machines see. The driver lists ids only; a partition is a run of commits, and a task
streams their patches out of one ``git log``. Revisions are resolved to ids before anything else sees them, so a
revision can't pass for an option; paths go to git, which then reads no other files.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COMMIT, FIELD = "\x01", "\x1f"
#: Commits of one partition, and bytes of git's output that a task reads at a time.
COMMITS, CHUNK = 200, 1 << 20
SCHEMA = "repo string, seq int, patch string"


def _git(repository: str, *words: str, feed: str | None = None) -> str:
    done = subprocess.run(["git", "-C", repository, *words], input=feed, capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(f"git failed in {repository}: {done.stderr.strip()}")
    return done.stdout


def resolved(repository: str, revision: str) -> str:
    """The id of the commit that ``revision`` names."""
    words = ["git", "-C", repository, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{revision}^{{commit}}"]
    done = subprocess.run(words, capture_output=True, text=True)
    if done.returncode:
        raise ValueError(f"revision {revision!r} does not exist in {repository}")
    return done.stdout.strip()


def commits(repository: str, since: str | None = None, until: str | None = None, all_refs: bool = False, max_count: int | None = None) -> list[str]:
    """Ids, the latest first."""
    if all_refs:
        span = ["--all"]
    else:
        span = [resolved(repository, until or "HEAD"), *([f"^{resolved(repository, since)}"] if since else [])]
    return _git(repository, "rev-list", *([f"--max-count={int(max_count)}"] if max_count else []), *span, "--").split()


def patches(repository: str, ids: list[str], paths: list[str], context: int) -> Iterator[str]:
    """Header and patch of each commit, as git puts them out."""
    words = ["git", "-C", repository, "--literal-pathspecs", "-c", "core.quotePath=false", "log", "-p", f"-U{int(context)}", "--no-color", "--no-ext-diff", "--no-renames", "--root", "--diff-filter=AM",
             f"--pretty=tformat:{COMMIT}%H{FIELD}%s", "--no-walk=unsorted", "--stdin", "--", *paths]
    with subprocess.Popen(words, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as task:
        task.stdin.write("".join(f"{i}\n" for i in ids).encode())
        task.stdin.close()
        held: list[bytes] = []
        while chunk := task.stdout.read(CHUNK):
            first, *others = chunk.split(COMMIT.encode())
            held.append(first)
            for part in others:
                if text := b"".join(held):
                    yield text.decode("utf-8", "replace")
                held = [part]
        if text := b"".join(held):
            yield text.decode("utf-8", "replace")
    if task.returncode:
        raise RuntimeError(f"git log failed in {repository} with status {task.returncode}")


class Run(InputPartition):
    def __init__(self, repository: str, first: int, ids: list[str]):
        self.repository, self.first, self.ids = repository, first, ids


def _runs(repository: str, ids: list[str]) -> list[Run]:
    return [Run(repository, i, ids[i : i + COMMITS]) for i in range(0, len(ids), COMMITS)]


class _Patches:
    def __init__(self, options: dict):
        self.repositories = json.loads(options["repositories"])
        self.paths = json.loads(options.get("paths", "[]"))
        self.context = int(options.get("context", 3))
        self.limits = {k: options.get(k) or None for k in ("since", "until")}
        self.limits |= {"all_refs": options.get("all_refs") == "true", "max_count": int(options.get("max_count") or 0) or None}

    def read(self, part: Run):
        if not part.ids:  # no commits at all
            return
        for seq, patch in enumerate(patches(part.repository, part.ids, self.paths, self.context), part.first + 1):
            yield part.repository, seq, patch


class HistoryReader(_Patches, DataSourceReader):
    def partitions(self):
        return [run for r in self.repositories for run in _runs(r, commits(r, **self.limits))] or [Run("", 0, [])]


class NewCommits(_Patches, DataSourceStreamReader):
    """Offsets are the ids of HEAD by repository."""

    def initialOffset(self) -> dict:
        return {r: "" for r in self.repositories}

    def latestOffset(self) -> dict:
        return {r: resolved(r, "HEAD") for r in self.repositories}

    def partitions(self, start: dict, end: dict):
        return [run for r in self.repositories for run in _runs(r, commits(r, start.get(r) or None, end[r]))]

    def commit(self, end: dict) -> None:
        pass


class GitHistory(DataSource):
    """Format ``credsift_git``: repo, seq, patch of each commit."""

    @classmethod
    def name(cls) -> str:
        return "credsift_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)

    def streamReader(self, schema) -> NewCommits:
        return NewCommits(self.options)

    @classmethod
    def ready(cls, spark: SparkSession) -> str:
        from .store import ship_package

        ship_package(spark)
        spark.dataSource.register(cls)
        return cls.name()

    @staticmethod
    def options_of(repositories, since=None, until=None, all_refs=False, max_count=None, paths=(), context=3) -> dict[str, str]:
        found = {"since": since, "until": until, "all_refs": "true" if all_refs else None, "max_count": max_count, "context": context}
        return {"repositories": json.dumps(list(repositories)), "paths": json.dumps(list(paths))} | {k: str(v) for k, v in found.items() if v is not None}
