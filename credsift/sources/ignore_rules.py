"""Ignore files of a tree as a table of rules, and which paths they leave out.

A rule belongs to the folder of its file. For each entry (a file, or a folder above one) the kinds of files come first: a rule of
a ``.ignore`` outweighs any of a ``.gitignore``, then ``.git/info/exclude``, then rules for all trees. Within a kind the deepest
folder counts, and there the last line that matches. A path is left out if it or any folder above it is: nothing below a
folder that is left out can be taken back.

Folders are judged once each, however many files they hold, and rules are joined by folder.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ship_package

#: Names of ignore files by weight; rules for all trees come last.
KINDS = [".ignore", ".gitignore", ".git/info/exclude", "global"]
RULES = "folder string, kind int, line int, rule string"


def body_regex(glob: str) -> str:
    """A glob as an expression: ``**`` between slashes crosses folders; ``*``, ``?`` and classes don't. Raises ValueError on a glob that isn't one."""
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == n or glob[i + 2] == "/"):
            if i + 2 == n:
                out, i = out + ".+", n
            else:
                out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if c == "*":
            while i + 1 < n and glob[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] not in ("!", "^") else i + 3)
            if end < 0:
                raise ValueError(f"{glob!r}: a class isn't closed")
            inner = glob[i + 1 : end]
            if inner[0] in "!^":
                inner = "^/" + inner[1:]
            for a, b in re.findall(r"([^\\])-([^\\])", inner):
                if a > b:
                    raise ValueError(f"{glob!r}: the range {a}-{b} is empty")
            out, i = out + "[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]", end
        elif c == "\\":
            if i + 1 == n:
                raise ValueError(f"{glob!r}: nothing follows the backslash")
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def parsed_rule(line: str) -> tuple[str, bool, bool] | None:
    """A line of an ignore file: the expression that a path below its folder satisfies, whether it takes back, whether only folders count."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    body = line[1:] if back else line
    folders = body.endswith("/") and not body.endswith("\\/")
    body = body.removesuffix("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    try:
        regex = body_regex(body)
    except ValueError:
        return None  # as a walker passes over lines it can't read
    return ("^" if anchored else "^(?:.*/)?") + regex + "$", back, folders


def rule_lines(ignore_files: DataFrame) -> DataFrame:
    """RULES of ignore files (path, text). A byte order mark at the start doesn't count."""
    kinds = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    name = F.when(F.col("path").rlike(r"(^|/)\.git/info/exclude$"), F.lit(KINDS[2])).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    folder = F.when(name == KINDS[2], F.regexp_replace("path", r"/?\.git/info/exclude$", "")).otherwise(F.regexp_replace("path", r"/?[^/]*$", ""))
    rows = ignore_files.filter(name.isin(KINDS[:3])).select(folder.alias("folder"), kinds[name].alias("kind"), F.posexplode(F.split(F.ltrim("text", F.lit("﻿")), "\n")).alias("line", "rule"))
    return rows.select("folder", "kind", "line", "rule")


def global_rules(spark: SparkSession, *rules: str) -> DataFrame:
    """RULES for all trees."""
    return spark.createDataFrame([("", len(KINDS) - 1, i, r) for i, r in enumerate(rules)], RULES)


def _expressions(rules: DataFrame) -> DataFrame:
    """folder, rules: for each folder an array of its rules as expressions."""
    ship_package(rules.sparkSession)

    def run(batches):
        for batch in batches:
            made = batch["rule"].map(parsed_rule)
            batch, made = batch[made.notna()], made[made.notna()]
            yield batch.assign(regex=[m[0] for m in made], back=[m[1] for m in made], folders=[m[2] for m in made])

    rows = rules.mapInPandas(run, RULES + ", regex string, back boolean, folders boolean")
    return rows.groupBy("folder").agg(F.collect_list(F.struct("kind", "line", "rule", "regex", "back", "folders")).alias("rules"))


def ancestors(path: Column) -> Column:
    """The folders above a path, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def decided(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, ignored, decided_at (the topmost entry left out, else null), rule (its rule) for the distinct paths of ``paths``."""
    above = ancestors(F.col("path"))
    files = paths.select("path").distinct().withColumn("entry", F.explode(F.concat(F.slice(above, 2, F.size(above)), F.array("path"))))
    files = files.withColumn("is_folder", F.col("entry") != F.col("path"))
    entries = files.select("entry", "is_folder").distinct().withColumn("folder", F.explode(ancestors(F.col("entry"))))
    met = entries.join(_expressions(rules), "folder")
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(folder) + 2)"))
    hits = F.filter("rules", lambda r: F.rlike(below, r.regex) & (F.col("is_folder") | ~r.folders))
    # of a kind the deepest folder, there the last line; of kinds the first
    best = F.array_max(F.transform(hits, lambda r: F.struct((-r.kind).alias("kind"), F.length("folder").alias("depth"), r.line.alias("line"), r.back.alias("back"), r.rule.alias("rule"))))
    told = met.withColumn("best", best).filter("best is not null").groupBy("entry", "is_folder").agg(F.max("best").alias("best")).filter("not best.back")
    out = files.join(told.select("entry", "is_folder", "best.rule"), ["entry", "is_folder"])
    first = out.groupBy("path").agg(F.min_by(F.struct("entry", "rule"), F.length("entry")).alias("first"))
    return paths.select("path").distinct().join(first, "path", "left").select("path", F.col("first").isNotNull().alias("ignored"), F.col("first.entry").alias("decided_at"), F.col("first.rule").alias("rule"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``files`` (path, ...) that no rule leaves out."""
    return files.join(decided(files, rules).filter("ignored").select("path"), "path", "left_anti")


def with_entry(text: str, entry: str) -> str:
    """The text of an ignore file with ``entry`` as a line of its own; as it is if it has it."""
    if any(line.strip() == entry for line in text.splitlines()):
        return text
    return text + ("\n" if text and not text.endswith("\n") else "") + entry + "\n"
