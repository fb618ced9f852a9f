"""The near-duplicate stage against all pairs of five-word shingle sets."""

import random
import re

import pytest

import corpus_pipeline
from credsift.llm import near_copies

SF = "/root/testdata/sf0.01"


def brute_kept(texts):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids, parent, pairs = sorted(sets), {i: i for i in sets}, 0

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))):
                pairs += a != b
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i for i in ids if find(i) == i}, pairs


@pytest.mark.parametrize("block", [500_000, 900])
def test_near_copies_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rnd = random.Random(5)
    rows = {}
    for g in range(30):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(4, 300))]
        for c in range(6):
            words = list(base)
            for _ in range(rnd.randrange(0, 2 + len(base) // 50)):
                words[rnd.randrange(len(words))] = f"new{rnd.randrange(99)}"
            rows[10 * g + c] = " ".join(words)
    crowd = [f"c{i}" for i in range(120)]
    for i in range(60):
        words = list(crowd)
        words[i] = f"own{i}"
        rows[1000 + i] = " ".join(words)
    want, pairs = brute_kept(rows)
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()}
    assert pairs > 500 and got == want


def test_stage_recall_on_given_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = brute_kept({r.doc_id: r.text for r in d.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()} == want
