"""Scanning lines for credentials: prefilter, extraction with byte columns, suppression comments, context.

A file's lines stay in one array until a line passes the prefilter, so context needs no shuffle and lines without a hit
never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import HINT, Pattern, patterns
from ..sources.corpus import TAG
from ..sources.files import MAX_LINE_BYTES, with_lines
from ..sources.git_patch import at_lines, hunks
from ..sources.store import written_sealed

CONTEXT_LINES = 3
FINDING = ["path", "line", "column", "match", "pattern", "pattern_ord", "severity", "context"]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _there(p: Pattern, text: str) -> str:
    """SQL for whether ``text`` holds a match of a pattern: its literals are looked for first, and only with one of them the expression is tried.

    Where case doesn't count, literals speak for ASCII lines only.
    """
    found = f"{text} rlike {_quoted(p.java)}"
    if p.consuming:
        prefix, capture, suffix = p.consuming
        found = f"exists(regexp_extract_all({text}, {_quoted(f'(?U){prefix}({capture}){suffix}')}, 1), v -> v rlike {_quoted(p.mark)})"
    if not p.literals:
        return found
    low = f"lower({text})" if p.flags else text
    some = " or ".join(f"contains({low}, {_quoted(x)})" for x in dict.fromkeys(p.literals))
    if p.flags:
        some = f"octet_length({text}) <> char_length({text}) or {some}"
    return f"(({some}) and {found})"


def _worth(text: str, rows: tuple[Pattern, ...]) -> str:
    """SQL for a line that holds a match: a hint first, then the patterns whose literals it has."""
    return f"({text} rlike {_quoted(HINT)} and ({' or '.join(_there(p, text) for p in rows)}))"


def candidate_lines(files: DataFrame, context: int = CONTEXT_LINES, rows: tuple[Pattern, ...] | None = None) -> DataFrame:
    """path, line, text, context, pragmas (of this line and the one before) for lines that some pattern matches.

    Hits become small rows within the file's own row; the array of all its lines isn't carried beside each.
    """
    rows = rows or patterns()
    line = lambda i: F.get("lines", i)

    def hit(at: Column) -> Column:
        window = F.slice("lines", F.greatest(at - context, F.lit(0)) + 1, F.least(at, F.lit(context)) + context + 1)
        named = F.concat(pragmas(line(at)), pragmas(F.coalesce(line(at - 1), F.lit(""))))
        return F.struct((at + 1).alias("line"), line(at).alias("text"), window.alias("context"), named.alias("pragmas"))

    at = F.expr(f"filter(transform(lines, (x, i) -> case when octet_length(x) <= {MAX_LINE_BYTES} and {_worth('x', rows)} then i end), i -> i is not null)")
    return with_lines(files).select("path", F.inline(F.transform(at, hit)))


def pragmas(line: Column, tag: str = TAG) -> Column:
    """The ids that a line's suppression comments name, in lower case; an empty id stands for every pattern."""
    return F.transform(F.regexp_extract_all(line, F.lit(rf"(?i)#?\s*{tag}:allow(?:\s+([a-z][a-z0-9_]*))?"), F.lit(1)), lambda x: F.lower(x))


def _matches(p: Pattern) -> str:
    """SQL for every match of a pattern in ``text``: its value, and the byte (from 1) at which that starts."""
    group = lambda i: f"regexp_extract_all(text, {_quoted(p.chained)}, {i})"
    found = f"zip_with({group(1)}, {group(2)}, (b, v) -> named_struct('b', octet_length(b), 'v', v, 'n', octet_length(b) + octet_length(v)))"
    if not p.ends_with_value:
        found = f"zip_with({found}, {group(0)}, (z, w) -> named_struct('b', z.b, 'v', z.v, 'n', octet_length(w)))"
    # each match with the bytes before it, gathered in one pass
    placed = f"aggregate({found}, named_struct('at', 0, 'rows', cast(array() as array<struct<column:int, match:string>>)), (a, z) -> named_struct('at', a.at + z.n, 'rows', a.rows || array(named_struct('column', a.at + z.b + 1, 'match', z.v))), a -> a.rows)"
    if p.consuming:
        placed = f"filter({placed}, z -> z.match rlike {_quoted(p.mark)})"
    row = f"named_struct('column', z.column, 'match', z.match, 'pattern', {_quoted(p.id)}, 'pattern_ord', {p.ord}, 'severity', {_quoted(p.severity)})"
    return f"case when {_there(p, 'text')} then transform({placed}, z -> {row}) end"


def extract(lines: DataFrame, rows: tuple[Pattern, ...] | None = None) -> DataFrame:
    """A row for every match in ``text``, in the order of the patterns; columns other than ``text`` are kept.

    The expressions are one SQL text: made call by call, sixty patterns' worth takes ten seconds before anything runs.
    """
    keep = [c for c in lines.columns if c != "text"]
    every = F.expr(f"flatten(filter(array({', '.join(map(_matches, rows or patterns()))}), x -> x is not null))")
    return lines.select(*keep, F.inline(every)).filter(F.length("match") > 0)


def scan(files: DataFrame, context: int = CONTEXT_LINES, suppress: bool = True, rows: tuple[Pattern, ...] | None = None, keep_hushed: bool = False) -> DataFrame:
    """Findings of files (path, text): path, line, column, match, pattern, pattern_ord, severity, context; with ``keep_hushed`` also whether a comment hushes them."""
    found = extract(candidate_lines(files, context, rows), rows).withColumn("hushed", F.exists("pragmas", lambda x: (x == "") | (x == F.col("pattern"))))
    if suppress:
        found = found.filter("not hushed")
    return found.select(*FINDING, "hushed") if keep_hushed else found.select(*FINDING)


def in_order(findings: DataFrame) -> DataFrame:
    """Findings by path (folder by folder), line and column; of equals in the order of the patterns."""
    return findings.orderBy(F.split("path", "/"), "line", "column", "pattern_ord")


def numbered(findings: DataFrame, name: str = "id") -> DataFrame:
    """``findings`` with their place (from 0, without gaps) in the order of ``in_order``.

    Rows are sorted by range; what precedes a partition is a sum over the partitions' counts, so no task sees all rows.
    """
    keys = [F.split("path", "/"), F.col("line"), F.col("column"), F.col("pattern_ord")]
    ranged = findings.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())  # partition, then place in it
    ranged = written_sealed(ranged, "ranged")
    part = F.shiftright(F.col(name), 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each partition
    starts = counts.select("_part", before.alias("_start"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).select(*ranged.columns)


def scan_history(commits: DataFrame, context: int = CONTEXT_LINES, rows: tuple[Pattern, ...] | None = None) -> DataFrame:
    """Findings in lines that commits (repo, seq, patch) add, of any length; suppression comments don't count there."""
    rows = rows or patterns()
    at = F.expr(f"filter(transform(lines, (x, i) -> case when startswith(x, '+') and {_worth('x', rows)} then i end), i -> i is not null)")
    return extract(at_lines(hunks(commits), at, context), rows)
