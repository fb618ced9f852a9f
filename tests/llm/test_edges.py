"""Every operator and stage: nulls, empty and long texts, ties and repeated rows, empty tables, clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credsift.llm import bpe, decontam, html_main, langid, line_dedup, near_copies, quality, repeats, shard_pack, simhash, token_store
from credsift.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, sig long, place int, fp long, h long, key long, _row string, size string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    long = " ".join(word() for _ in range(30_000))
    plain = [" ".join(word() for _ in range(40)) + ".\nSecond line of this text, long enough to count." for _ in range(6)]
    return [None, "", " \n\t ", "a", "x" * 5000, long, *plain, plain[0], "no letters 123"[:0] + "12 34 !!", "\U0001f600 émoji \u0000 nul", "line\r\nline\r\n"]


@pytest.fixture(scope="module")
def edge(spark, texts):
    rows = [(i, t, None if i % 3 else ("en" if i % 2 else "fr"), "s", 1, 7, 8, 9, 10, 11, 12, "r", "z") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, texts[7], "en", None, None, 1, 1, 1, 1, 1, 1, "q", "y"), (None, None, None, None, None, 1, 1, 1, 1, 1, 1, "q", "y")]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None, "e"), (2, "", "e"), (3, "too short", "e"), (4, "one two three four five six seven eight nine ten", "e")], "item_id long, text string, doc_id string")


OPERATORS = {
    "op1": lambda d, b: shard_pack.assign_shards(d),
    "op2": lambda d, b: langid.identify(d),
    "op3": lambda d, b: token_store.read_store(d.sparkSession, token_store.write_store(d, tokenizer_path(), 2)),
    "op4": lambda d, b: simhash.near_duplicates(d),
    "op5": lambda d, b: line_dedup.line_report(d),
    "op6": lambda d, b: bpe.encode_decode(d, tokenizer_path()),
    "op9": lambda d, b: quality.assess(d),
    "op10": lambda d, b: repeats.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, edge, bench):
    got = OPERATORS[name](edge, bench).collect()
    assert len(got) == edge.count()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in edge.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, edge, bench):
    assert OPERATORS[name](edge.filter("false"), bench).collect() == []


def test_leaks_on_edges(edge, bench, spark):
    assert decontam.find_leaks(edge, bench).collect() == []
    assert decontam.find_leaks(edge.filter("false"), bench).count() == 0
    assert decontam.find_leaks(edge, bench.filter("false")).count() == 0
    leak = spark.createDataFrame([(5, "x y One, two three four FIVE six seven eight nine ten z")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in decontam.find_leaks(leak, bench).collect()] == [(5, 4, 0)]


def test_pages_on_edges(spark):
    rows = [(1, None, None, "t"), (2, "", "", "t"), (None, "http://h/", "<article><p>a", "t"), (3, "http://h/", "<p>only " + "word " * 9, "t"), (3, "http://h/", "<p>only " + "word " * 9, "t"), (4, "u", "<<a b='>' <article x=\"<p>\">T&amp;&lt;&copy</article><arti", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_main.main_text(pages).collect()]
    assert len(got) == 6 and (None, "a", 1) in got and (1, "", 0) in got and (2, "", 0) in got
    assert ("<T&<©" in {t for _, t, _ in got}) and html_main.main_text(pages.filter("false")).count() == 0


def test_repeats_and_ties(spark):
    same = "A text that is there three times, word for word, and so is its own copy. " * 4
    d = spark.createDataFrame([(3, same), (1, same), (2, same), (2, same)], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(d).collect()} == {1}
    assert [r.doc_id for r in near_copies.keep_one(d).collect()] == [1]
    assert {(r.n_removed == r.n_bytes, r.n_spans) for r in repeats.remove_repeats(d).collect()} == {(True, 1)}
    assert {r.left_whole for r in line_dedup.line_report(d).collect()} == {False, True}
    assert len({r.shard for r in shard_pack.assign_shards(spark.range(240).select(F.col("id").alias("doc_id"), F.lit(same).alias("text"))).collect()}) == 24


def test_stages_keep_columns_and_survive(spark, edge, tmp_path, bench):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, edge.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_shingles_do_not_stay_on_the_disk(spark):
    import glob

    from credsift.llm import jaccard_join
    from credsift.sources.store import shared_dir

    shared = shared_dir(spark).removeprefix("file://")
    before = {k: set(glob.glob(f"{shared}/{k}-*/*.parquet")) for k in ("shingle-marks", "first-keys", "met", "shared-shingles")}
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, text), (4, "other words here and there"), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.linked(docs).collect()))
    assert got == [(1, 56, 1), (2, 57, 1), (3, 56, 1), (4, 1, 4), (5, 0, 5)]
    assert all(set(glob.glob(f"{shared}/{k}-*/*.parquet")) == files for k, files in before.items())  # all stayed before
