"""Proposals to read a value from the environment instead, and their application to whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lists import CALLS
from ..functions.text import env_call, env_name, language, redacted, replace_first, seed_commands
from ..sources.files import read_file, with_lines
from .report import write_document

HEADING = "# Added by credsift:"


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once: a filter on them isn't pushed below, where it would compute them again."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def propose(findings: DataFrame, include_unknown: bool = True, backend: str = "env", force: bool = False) -> DataFrame:
    """Proposals for real findings, unknown ones too unless left out, and with ``force`` for all: path, line, column, pattern, env_var, language, old_line (redacted), new_line, env_example_line, seed_command."""
    wanted = ["real", "unknown"] if include_unknown else ["real"]
    rows = findings.filter(F.lit(force) | F.col("verdict").isin(wanted)).withColumn("language", language(F.col("path")))
    rows = rows.filter(F.col("language").isin(*CALLS))
    rows = _once(rows, source=F.get(F.filter("context", lambda x: F.contains(x, F.col("match"))), F.lit(0))).filter("source is not null")
    rows = _once(rows, env_var=env_name(F.col("source"), F.col("pattern")))
    rows = _once(rows, call=env_call(F.col("language"), F.col("env_var")))
    rows = _once(rows, new_line=replace_first(F.col("source"), F.col("match"), F.col("call"))).filter("new_line <> source")
    return rows.select(
        "path", "line", "column", "pattern", "env_var", "language", F.replace("source", "match", redacted(F.col("match"))).alias("old_line"), "new_line",
        F.concat("env_var", F.lit("=")).alias("env_example_line"), seed_commands(F.col("env_var"), backend).alias("seed_command"),
    )


def env_example(proposals: DataFrame, existing: str = "") -> DataFrame:
    """The lines to add to an example file: distinct, in order, without names that stand in it already."""
    return proposals.filter(~F.contains(F.lit(existing), F.col("env_var"))).select("env_example_line").distinct().orderBy("env_example_line")


def write_env_example(proposals: DataFrame, path: str) -> None:
    """Adds what ``env_example`` gives to the file at ``path`` under a heading; a file that isn't there is made, and none where nothing is proposed."""
    spark = proposals.sparkSession
    existing = read_file(spark, path).select("text").collect()  # one file, read for the names in it
    before = existing[0].text if existing else ""
    if not proposals.limit(1).count():
        return
    lines = env_example(proposals, before)
    place = F.row_number().over(Window.orderBy("env_example_line")) - 1  # names of variables, as few as an example file has
    head = before + ("\n" if before and not before.endswith("\n") else "") + HEADING + "\n"
    write_document(lines.select(place.alias("id"), F.col("env_example_line").alias("value")), head, "", path, between="")


def rewritten(files: DataFrame, findings: DataFrame) -> DataFrame:
    """path, before, text: files that have findings to replace, as they were and as they become."""
    rows = findings.filter(F.col("verdict").isin("real", "unknown")).withColumn("language", language(F.col("path")))
    edits = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "column", "match", "pattern", "language"))).alias("edits"))

    def rewrite(line, number):
        mine = F.filter("edits", lambda e: e["line"] == number + 1)

        def one(text, e):
            name = env_name(text, e["pattern"])
            return F.when(F.contains(text, e["match"]), F.coalesce(replace_first(text, e["match"], env_call(e["language"], name)), text)).otherwise(text)

        return F.aggregate(mine, line, one)

    both = files.select("path", "text").join(edits, "path")  # split only then: texts travel in one piece
    return with_lines(both.withColumn("before", F.col("text"))).select("path", "before", F.array_join(F.transform("lines", rewrite), "\n").alias("text"))


def apply_rewrites(files: DataFrame, findings: DataFrame, backend: str = "env") -> DataFrame:
    """path, text: files with each finding's own line replaced where it still holds the value."""
    return rewritten(files, findings).select("path", "text")


def unified_diffs(before: DataFrame, after: DataFrame, radius: int = 3) -> DataFrame:
    """path, diff for files that change."""
    return diffs(before.select("path", F.col("text").alias("before")).join(after.select("path", "text"), "path"), radius)


def diffs(files: DataFrame, radius: int = 3) -> DataFrame:
    """path, diff for files (path, before, text) that change."""
    both = files.select("path", "before", "text").filter("before <> text")

    def run(batches):
        import difflib

        import pandas as pd

        for batch in batches:
            diffs = ["".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), f"a/{p}", f"b/{p}", n=radius)) for p, a, b in batch.itertuples(index=False)]
            yield pd.DataFrame({"path": batch["path"], "diff": diffs})

    return both.mapInPandas(run, "path string, diff string")
