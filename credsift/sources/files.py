"""File sources: which paths are read, and how a file's bytes become lines."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lists import EXTENSIONS
from .ignore_rules import body_regex, global_rules, not_ignored, rule_lines
from .store import ship_package, written

MAX_FILE_BYTES, MAX_LINE_BYTES, SNIFF_BYTES = 2 << 20, 8192, 8192


def glob_regex(glob: str) -> str:
    """The expression of an exclude glob, for the path or a folder above it; a bare name matches at any depth. ValueError on a glob that isn't one."""
    anchored = glob.startswith("/") or "/" in glob.strip("/")
    return ("^" if anchored else "(?:^|/)") + body_regex(glob.strip("/")) + "(?:/|$)"


def scannable(path: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Known extension or a dotenv name, not below ``.claude/worktrees``, in no exclude glob."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    ok = extension.isin(EXTENSIONS) | name.startswith(".env")
    ok = ok & ~path.rlike(r"(?:^|/)\.claude/worktrees/")
    for glob in exclude:
        ok = ok & ~path.rlike(glob_regex(glob))
    return ok


def readable_text(content: Column) -> Column:
    """The text of a file's bytes: null for a NUL in the first bytes or for bytes that aren't UTF-8."""
    binary = F.instr(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00")) > 0
    return F.when(~binary & F.is_valid_utf8(content), F.decode(content, "UTF-8"))


def _store(path: str):
    """The file system of a path, and the path in it. Local paths are taken as they are."""
    from pyarrow import fs

    if path.startswith(("/", "file:/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _listed(batches):
    """Entries of folders. Links aren't followed; folders that can't be read are passed over."""
    import pyarrow as pa
    from pyarrow import fs

    kind = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_())])
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            store, where = _store(folder)
            try:
                found = store.get_file_info(fs.FileSelector(where))
            except OSError:
                continue
            if isinstance(store, fs.LocalFileSystem):
                found = [x for x in found if not os.path.islink(x.path)]
            rows = [(f"{folder}/{x.base_name}", x.size or 0, x.type == fs.FileType.Directory) for x in found]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)


def _read(batches):
    import pyarrow as pa

    kind = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in batches:
        for path, uri in zip(batch.column("path").to_pylist(), batch.column("uri").to_pylist()):
            store, where = _store(uri)
            try:
                with store.open_input_stream(where) as f:
                    content = f.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_pylist([{"path": path, "content": content}], schema=kind)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), length, uri of every file of a tree, hidden ones included, in a store that driver and executors see.

    A round lists the folders that the last one found, each in some task: as many rounds as the tree is deep, and no list of files
    passes through the driver.
    """
    ship_package(spark)
    base = root.rstrip("/")
    folders, rounds = spark.createDataFrame([(base,)], "path string"), []
    while True:
        listed = written(folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_listed, "path string, length long, is_folder boolean"), "listing")
        rounds.append(listed.filter("not is_folder"))
        folders = listed.filter("is_folder").filter(~F.col("path").rlike(r"/\.claude/worktrees$")).select("path")
        if not folders.limit(1).count():
            break
    return reduce(DataFrame.union, rounds).select(F.substring("path", len(base) + 2, 1 << 20).alias("path"), "length", F.col("path").alias("uri"))


def contents(files: DataFrame) -> DataFrame:
    """path, text of the text files among rows of ``walk``; what can't be read is passed over."""
    dealt = files.select("path", "uri").repartition(files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(_read, "path string, content binary").select("path", readable_text(F.col("content")).alias("text")).filter("text is not null")


def normalised(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts."""

    def step(kept: Column, part: Column) -> Column:
        less = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(part.isin("", "."), kept).when(part == "..", less).otherwise(F.array_append(kept, part))

    return F.array_join(F.reduce(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def read_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), only: DataFrame | None = None, max_file_bytes: int = MAX_FILE_BYTES, use_ignore_files: bool = True, ignore_rules: tuple[str, ...] = ()) -> DataFrame:
    """path (below ``root``), text. Ignore files of the tree and ``ignore_rules`` for all of it hold; large files and files of other kinds are dropped before they are opened."""
    every = walk(spark, root)
    rows = every.filter(F.col("length") <= max_file_bytes).filter(scannable(F.col("path"), exclude))
    if only is not None:
        rows = rows.join(only.select(normalised(F.col("path")).alias("path")).distinct(), "path", "left_semi")
    rules = global_rules(spark, *ignore_rules)
    if use_ignore_files:
        rules = rules.union(rule_lines(contents(every.filter(F.col("path").rlike(r"(?:^|/)(?:\.gitignore|\.ignore|\.git/info/exclude)$")))))
    return contents(not_ignored(rows, written(rules, "rules")))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """path, text of one file, whatever its kind; binary files give no row."""
    return contents(spark.createDataFrame([(path.rsplit("/", 1)[-1], path)], "path string, uri string"))


def with_lines(files: DataFrame) -> DataFrame:
    """The files with ``lines``: split at line feeds, carriage returns at the ends dropped."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\r+$", ""))
    return files.withColumn("lines", lines).drop("text")


def doc_lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text, n_bytes."""
    rows = with_lines(files).select("path", F.posexplode("lines").alias("at", "text"))
    return rows.select("path", (F.col("at") + 1).alias("line"), "text", F.octet_length("text").cast("long").alias("n_bytes"))
