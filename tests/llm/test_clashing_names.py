"""Columns of a user that have the names of internal ones come back as they were."""

import pytest

from credsift.llm import decontam, line_dedup, near_copies, quality

NAMES = ["_id", "_sig", "_lower", "_row", "_t", "row", "sig", "id", "gone", "key", "h"]
STAGES = {
    "quality": quality.filter_documents,
    "lines": line_dedup.dedup_lines,
    "near copies": near_copies.keep_one,
    "benchmark": lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([(1, "a question that no text here holds at all, not one")], "item_id long, text string")),
}


@pytest.mark.parametrize("stage", STAGES)
def test_a_stage_keeps_columns_of_any_name(spark, stage):
    text = "Harbour lights shone over the quiet water, and the old ferry turned home. Nobody aboard spoke until the pier was near."
    rows = [(1, text, *(f"{n} of one" for n in NAMES)), (2, None, *(f"{n} of two" for n in NAMES))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    got = STAGES[stage](docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect() if r.doc_id == 1] == [rows[0]]
