"""The pipeline's line stage: thresholds by length against all pairs, and short equal lines."""

import random

from test_operators import levenshtein

from credsift.llm import line_dedup


def edited(rnd, x, edits):
    for _ in range(edits):
        p, o = rnd.randrange(len(x)), rnd.randrange(3)
        x = x[:p] + (rnd.choice("xyzé") if o != 1 else "") + x[p + (o < 2) :]
    return x


def near(a, b):
    long = max(len(a), len(b))
    return a != b and min(len(a), len(b)) >= 16 and levenshtein(a, b) <= (2 if long >= 96 else 1)


def expected(lines):
    first, want = {}, {}
    for i, x in enumerate(lines):
        want[i] = f"own {i}" if x in first or any(near(m, x) for m in first) else f"{x}\nown {i}"
        first.setdefault(x, i)
    return want


def rows(spark, lines):
    return spark.createDataFrame([(i, f"{x}\nown {i}") for i, x in enumerate(lines)], "doc_id long, text string")


def test_near_lines_by_length_against_all_pairs(spark):
    rnd = random.Random(8)
    lines = []
    for size in (15, 16, 17, 40, 94, 95, 96, 97, 98, 150, 400) * 2:
        base = "".join(rnd.choice("abcdefghiklmnoprstu ") for _ in range(size - 1)) + "."
        lines += [base, *(edited(rnd, base, n) for n in (1, 1, 2, 2, 3))]
    want = expected(lines)
    assert sum(len(w) < 9 for w in want.values()) > 40
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(rows(spark, lines)).collect()} == want


def test_crowded_segments_against_all_pairs(spark, monkeypatch):
    """Many lines with one equal part and different others, among them near ones, with the crowd's keys in use."""
    monkeypatch.setattr(line_dedup, "CROWD", 3)
    rnd, lines = random.Random(9), []
    for head, tail in (("the same first half of it ", 26), ("a longer head of a hundred and more characters that all of the lines have, whatever comes after it, ", 60)):
        for _ in range(14):
            x = head + "".join(rnd.choice("abcdefgh ") for _ in range(tail - 1)) + "."
            lines += [x, *(edited(rnd, x, n) for n in (1, 2, 3))]
    want = expected(lines)
    assert sum(len(w) < 9 for w in want.values()) > 30
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(rows(spark, lines)).collect()} == want


def test_short_equal_lines_go(spark):
    d = spark.createDataFrame([(1, "Share\n\nfirst words"), (2, "Share\n\nother words\nShare")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()} == {1: "Share\n\nfirst words", 2: "\nother words"}
