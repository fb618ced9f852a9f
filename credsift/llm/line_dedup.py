"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

A line that isn't blank is removed if an equal line, or a near one, comes earlier (by document id, then place). Lines of
``MIN_CHARS`` or more characters are near within the edits that ``LADDER`` allows for the longer line's length. Lines are
reduced to 128-bit hashes first, so equal lines meet once. For the edit join each distinct line is cut into one more
segment than its threshold; a line within the threshold holds one of them unchanged at a place that the two lengths
bound, so an index of segments by length is probed with the few substrings that can match. Lines that meet in no segment
never carry their text anywhere; for the others it is fetched. Lines whose letter counts differ by more than the edits can
change are passed over, and a banded bit-parallel edit distance decides on the others (``within``: a band of 2 k + 1
diagonals in one long, shifted along the longer line). A semi-join asks only whether an earlier line
exists, so a crowd of alike lines gives one row each, not a row for each pair.

A segment that more than ``CROWD`` lines share (one equal half, many different others) isn't joined on. Its lines are cut
into ``FINE`` more segments than the threshold, of which all but the threshold's number are intact, and meet only on all of
those at once.

A document all of whose words stand in removed lines is a copy; it is left whole, for document deduplication to judge.

Edge cases: null texts have no lines and stay null; blank lines always stay; line ends are single line feeds; very long
lines are compared whole; rows alike in id and text are taken for one; null ids come first; an empty table gives an empty
result; other columns, of any name, are ignored by ``line_report`` and kept by ``dedup_lines``.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, bounded, staged

MIN_CHARS = 16
#: From so many characters of the longer line on, so many edits. More steps multiply the probes: about k ** 3 / 3 a line.
LADDER = ((MIN_CHARS, 1), (96, 2))
CROWD, FINE = 64, 4
BAGS = ("ab", "cd", "e", "fg", "hi", "jkl", "mn", "o", "pq", "rs", "t", "uvw", "xyz")


def allowed(length: Column, ladder=LADDER) -> Column:
    """The edits that a longer line of this length allows."""
    out = F.lit(0)
    for least, k in ladder:
        out = F.when(length >= least, k).otherwise(out)
    return out


def _cut(j: int, other: str, parts: int) -> str:
    """The characters of the first j of so many even segments."""
    return f"cast({j} * {other} div {parts} as int)" if 0 < j < parts else other if j else "0"


def _segment(i: int, other: str, parts: int, shift: int) -> str:
    before = _cut(i - 1, other, parts)
    return f"substring(line, {before} + {1 + shift}, {_cut(i, other, parts)} - {before})"


def segment_keys(k: int):
    """(indexed, SQL): a key of each of a line's own segments, and those it probes for lines up to ``k`` characters shorter."""
    for shorter in range(k + 1):
        other = f"(len - {shorter})"
        for i in range(1, k + 2):
            low, high = max(1 - i, shorter - (k + 1 - i)), min(i - 1, shorter + (k + 1 - i))
            for shift in range(low, high + 1):
                yield shorter == 0 and shift == 0, f"xxhash64({16 * k + i}, {other}, {_segment(i, other, k + 1, shift)})"


def fine_keys(k: int):
    """The same for crowds: of k + ``FINE`` segments all but k must agree, each at a shift that k edits can cause."""
    parts = k + FINE
    for shorter in range(k + 1):
        other = f"(len - {shorter})"
        for broken in combinations(range(1, parts + 1), k):
            # Shifts change at broken segments only and end at the difference of the lengths.
            for steps in product(range(-k, k + 1), repeat=k):
                if sum(steps) != shorter or sum(map(abs, steps)) > k:
                    continue
                whole = [_segment(i, other, parts, sum(s for b, s in zip(broken, steps) if b < i)) for i in range(1, parts + 1) if i not in broken]
                yield shorter == 0 and not any(steps), f"xxhash64({-sum(1 << b for b in broken) - k}, {other}, {', '.join(whole)})"


def line_keys(make, ladder=LADDER) -> Column:
    """key, indexed: all keys of ``line`` of ``len`` characters. One SQL text: made call by call they take longer than the join.

    A line a little below a step is indexed for the longer ones that probe it.
    """
    arrays, ends = [], [s for s, _ in ladder[1:]] + [1 << 30]
    for (least, k), end in zip(ladder, ends):
        keys = [*make(k)]
        own = ", ".join(f"struct({x} as key, true as indexed)" for indexed, x in keys if indexed)
        probes = ", ".join(f"struct({x} as key, false as indexed)" for indexed, x in keys if not indexed)
        arrays.append(f"case when len >= {max(MIN_CHARS, least - k)} and len < {end} then array({own}) end")
        arrays.append(f"case when len >= {max(MIN_CHARS, least)} and len < {end} then array({probes}) end")
    return F.expr(f"flatten(filter(array({', '.join(arrays)}), x -> x is not null))")


def within(x: Column, y: Column, ladder=LADDER) -> Column:
    """Whether two lines are near by their edit distance: what they share at both ends is passed over, a band decides on the rest."""
    longest = F.greatest(F.char_length(x), F.char_length(y))
    close = F.abs(F.char_length(x) - F.char_length(y)) <= allowed(longest, ladder)
    decide = lambda s: _distance(s["x"], s["y"], max(e for _, e in ladder)) <= allowed(longest, ladder)
    return F.when(close, F.transform(F.array(_differing(x, y)), decide)[0]).otherwise(False)


def _differing(x: Column, y: Column) -> Column:
    """x, y without what they share at both ends, but for up to 15 characters each."""
    sizes = F.lit([1 << b for b in range(15, 3, -1)])
    rest = lambda s, cut: F.struct(cut("x").alias("x"), cut("y").alias("y"))

    def front(s: Column, n: Column) -> Column:
        return F.when(F.left(s["x"], n) == F.left(s["y"], n), rest(s, lambda c: F.substr(s[c], n + 1))).otherwise(s)

    def back(s: Column, n: Column) -> Column:
        return F.when(F.right(s["x"], n) == F.right(s["y"], n), rest(s, lambda c: F.left(s[c], F.char_length(s[c]) - n))).otherwise(s)

    return F.aggregate(sizes, F.aggregate(sizes, F.struct(x.alias("x"), y.alias("y")), front), back)


def _distance(x: Column, y: Column, k: int) -> Column:
    """The edit distance of two lines at most ``k`` characters apart in length, right if it is at most ``k``.

    Columns of a band of 2 k + 1 diagonals are bit-parallel. Bit b of column i stands for the shorter line's character
    i + b - k. ``vp`` and ``vn`` say where the distance grows or falls down a column, ``d0`` where a cell equals its neighbour
    up the diagonal; each set bit on the last cell's diagonal saves one of as many edits as the longer line has characters.
    """
    full = (1 << (2 * k + 1)) - 1
    n, m = F.greatest(F.char_length(x), F.char_length(y)), F.least(F.char_length(x), F.char_length(y))
    longer = F.split(F.when(F.char_length(x) >= F.char_length(y), x).otherwise(y), "")
    shorter = F.split(F.when(F.char_length(x) >= F.char_length(y), y).otherwise(x), "")
    bit = lambda p, c, i, b: F.when(F.get(p, i + (b - k)) == c, F.lit(1 << b)).otherwise(F.lit(0)).cast("long")

    def masks(p: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = bit(p, c, i, 0)
            for b in range(1, 2 * k + 1):
                out = out.bitwiseOR(bit(p, c, i, b))
            return out

        return F.transform(longer, one)

    def step(s: Column, pm: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(full))

        def after(d: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)))
            down = F.shiftright(d, 1)
            new = d.bitwiseAND(vp).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(full))
            hit = F.call_function("getbit", d, s["at"])
            return F.struct(new.alias("vp"), down.bitwiseAND(hp).alias("vn"), s["at"].alias("at"), (s["hits"] + hit).alias("hits"))

        return F.transform(F.array(d0), after)[0]

    first = F.struct(F.lit(full - (1 << k) + 1).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), (k - (n - m)).cast("int").alias("at"), F.lit(0).alias("hits"))
    return n - F.aggregate(F.transform(F.array(shorter), masks)[0], first, step, lambda s: s["hits"])


def _lines(documents: DataFrame) -> DataFrame:
    """id, sig, place, line for every line that isn't blank."""
    text = F.col("text").cast("string")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("sig"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return rows.filter(F.col("line").rlike(r"\S"))


HASHES = [F.xxhash64, lambda x: F.xxhash64(F.lit(7), x)]


def _hashed(line: str = "line") -> list[Column]:
    return [make(F.col(line)).alias(name) for name, make in zip("hg", HASHES)]


def _fetch(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """first, line, bag for the places of ``wanted`` (first)."""
    wanted = wanted.select(F.col("first.id").alias("id"), F.col("first.sig").alias("sig"), F.col("first.place").alias("place")).distinct()
    return _lines(documents).join(bounded(wanted), ["id", "sig", "place"], "left_semi").select(F.struct("id", "sig", "place").alias("first"), "line", _bag(F.col("line")).alias("bag")).dropDuplicates(["first"])


def _bag(line: Column) -> Column:
    """How often the letters of each of ``BAGS`` occur. An edit changes these counts by two in all at most."""
    return F.struct(*((F.char_length(line) - F.char_length(F.translate(line, some, ""))).alias(some) for some in BAGS))


def _near(full: DataFrame, ladder, crowded: bool = False) -> DataFrame:
    """h, g of the lines of ``full`` (key, indexed, first, line, bag, h, g) that have an earlier near line under a key.

    In crowds, where most pairs are too far apart, Spark's distance with a threshold passes these over first.
    """
    full = full.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")  # few bytes, much to compare
    p, q = full.alias("p"), full.alias("q")
    met = (F.col("p.key") == F.col("q.key")) & (F.col("q.first") < F.col("p.first")) & (F.col("p.indexed") | F.col("q.indexed"))
    apart = sum((F.abs(F.col(f"p.bag.{some}") - F.col(f"q.bag.{some}")) for some in BAGS), F.lit(0))
    most = max(k for _, k in ladder)
    met = met & (apart <= 2 * most)
    if crowded:
        met = met & (F.levenshtein("p.line", "q.line", most) >= 0)
    return p.join(q, met & within(F.col("p.line"), F.col("q.line"), ladder), "left_semi").select("h", "g")


def removals(documents: DataFrame, ladder=LADDER) -> DataFrame:
    """id, sig, gone (places and whether the line was merely near): one row for each document that loses lines."""
    rows = _lines(documents).withColumn("len", F.char_length("line")).select("id", "sig", "place", *_hashed(), line_keys(segment_keys, ladder).alias("keys"))
    distinct = staged(rows.groupBy("h", "g").agg(F.min(F.struct("id", "sig", "place")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")), "lines")

    # At equal lengths a segment that stands where the index has it is its own probe.
    met = distinct.select("h", F.explode("keys").alias("k")).select("h", "k.*").groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.bool_or("indexed").alias("any"), F.count("*").alias("m"))
    met = staged(met.filter("any and a <> b").select("key", (F.col("m") > CROWD).alias("crowd")), "segments")
    close = staged(distinct.select("h", "g", "first", F.explode("keys").alias("k")).select("h", "g", "first", "k.*").join(bounded(met), "key"), "near-lines")
    texts = staged(_fetch(documents, close), "near-texts")
    few = close.filter("not crowd").join(texts, "first")
    many = close.filter("crowd").select("h", "g", "first").distinct().join(texts, "first").withColumn("len", F.char_length("line"))
    many = many.select("h", "g", "first", "line", "bag", F.explode(line_keys(fine_keys, ladder)).alias("k")).select("h", "g", "first", "line", "bag", "k.*")
    later = _near(few, ladder).union(_near(many, ladder, True)).distinct().withColumn("near", F.lit(True))
    bad = distinct.select("h", "g", "first", "n").join(bounded(staged(later, "later")), ["h", "g"], "left").filter("n > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    bad = staged(bad, "bad-lines")
    places = _lines(documents).select("id", "sig", "place", *_hashed())
    gone = places.join(bounded(bad), ["h", "g"]).filter(F.col("near") | (F.struct("id", "sig", "place") != F.col("first")))
    return gone.groupBy("id", "sig").agg(F.collect_set(F.struct("place", "near")).alias("gone"))


def _with_kept(documents: DataFrame, ladder) -> DataFrame:
    """row (the document), gone, whole, and kept: the text without its removed lines (or whole)."""
    gone = staged(removals(documents, ladder), "removed-lines")
    text = F.col("row.text").cast("string")
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    keyed = keyed.withColumn("id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID))).withColumn("sig", F.xxhash64(text))
    joined = keyed.join(bounded(gone), ["id", "sig"], "left")
    out = F.map_from_entries(F.transform("gone", lambda x: F.struct(x["place"], x["near"])))
    stay = F.transform(F.array(out), lambda m: F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.map_contains_key(m, i)), "\n"))[0]
    joined = joined.withColumn("rest", F.when(F.col("gone").isNotNull(), stay))
    whole = F.col("gone").isNull() | ~F.col("rest").rlike(r"\S")
    return joined.select("row", "gone", whole.alias("whole"), F.when(whole, text).otherwise(F.col("rest")).alias("kept"))


def line_report(documents: DataFrame, ladder=LADDER) -> DataFrame:
    """doc_id, n_lines, n_equal and n_near (lines removed), left_whole, kept_sha256 (of the text that is left)."""
    made = _with_kept(documents, ladder)
    lost = F.when(~F.col("whole"), F.col("gone"))
    count = lambda near: F.coalesce(F.size(F.filter(lost, lambda x: x["near"] == F.lit(near))), F.lit(0)).cast("long")
    return made.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.size(F.split(F.col("row.text").cast("string"), "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(lost.isNull(), F.lit(0)).otherwise(count(False)).cast("long").alias("n_equal"),
        F.when(lost.isNull(), F.lit(0)).otherwise(count(True)).cast("long").alias("n_near"),
        (F.col("whole") & F.col("gone").isNotNull()).alias("left_whole"),
        F.sha2(F.coalesce(F.col("kept"), F.lit("")), 256).alias("kept_sha256"),
    )


def dedup_lines(documents: DataFrame, ladder=LADDER) -> DataFrame:
    """``documents`` without the removed lines; all rows and columns stay (``n_chars``, where there is one, counts the new text)."""
    made = _with_kept(documents, ladder)
    counted = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.char_length("kept")) if "n_chars" in documents.columns else None
    new = {"text": F.col("kept"), "n_chars": counted}
    return made.select(*((new[c].cast(documents.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in documents.columns))


#: DuckDB SQL for ``line_report`` with the defaults. Its edit distance counts bytes, so each letter beyond ASCII becomes a control
#: character first (right for up to 28 different ones; the tables hold 25).
REPORT_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place
  FROM documents WHERE text IS NOT NULL
), words AS (SELECT * FROM lines WHERE regexp_matches(line, '\S')),
letters AS (
  SELECT string_agg(c, '' ORDER BY c) AS wide FROM (SELECT DISTINCT unnest(regexp_extract_all(line, '[^\x00-\x7F]')) AS c FROM lines)
), narrow AS (
  SELECT string_agg(chr(i::INT), '' ORDER BY i) AS thin FROM range(1, 32) AS r(i) WHERE i NOT IN (9, 10, 13)
), first AS (
  SELECT line, min((doc_id, place)) AS pos, length(line) AS len, any_value(translate(line, wide, thin[1:length(wide)])) AS thin
  FROM words, letters, narrow GROUP BY line
), near AS (
  SELECT DISTINCT b.line FROM first a JOIN first b ON a.pos < b.pos AND greatest(a.len, b.len) >= 16
    AND a.len BETWEEN b.len - 2 AND b.len + 2 AND least(a.len, b.len) >= 16
  WHERE levenshtein(a.thin, b.thin) <= CASE WHEN greatest(a.len, b.len) >= 96 THEN 2 ELSE 1 END
), marked AS (
  SELECT l.doc_id, l.place, l.line, n.line IS NOT NULL AS near, n.line IS NULL AND (l.doc_id, l.place) <> f.pos AS equal
  FROM lines l LEFT JOIN first f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
), made AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE equal) AS n_equal, count(*) FILTER (WHERE near) AS n_near,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT (coalesce(near, false) OR coalesce(equal, false))), '') AS rest
  FROM marked GROUP BY doc_id
), told AS (SELECT *, n_equal + n_near > 0 AND NOT regexp_matches(rest, '\S') AS whole FROM made)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, CASE WHEN t.whole THEN 0 ELSE coalesce(t.n_equal, 0) END::BIGINT AS n_equal,
       CASE WHEN t.whole THEN 0 ELSE coalesce(t.n_near, 0) END::BIGINT AS n_near, coalesce(t.whole, false) AS left_whole,
       sha256(CASE WHEN t.whole OR t.doc_id IS NULL THEN coalesce(d.text, '') ELSE t.rest END) AS kept_sha256
FROM documents d LEFT JOIN told t USING (doc_id)
"""
