"""The verdict of the quality rules against an expectation-maximisation of its own, document by document."""

import random

import numpy as np
from pyspark.sql import functions as F

from credsift.llm import quality

SF = "/root/testdata/sf0.001"


def brute_posterior(votes: np.ndarray) -> np.ndarray:
    """Posterior of "good" for rows of votes."""
    n, rules = votes.shape
    good = np.where((votes == -1).any(1), 0.05, 0.95)
    for _ in range(quality.ROUNDS):
        share = (good.sum() + quality.PSEUDO * quality.SHARE) / (n + quality.PSEUDO)
        up, down = np.full(n, share), np.full(n, 1 - share)
        for r in range(rules):
            for vote in (-1, 0, 1):
                cast = votes[:, r] == vote
                start = quality.START[vote]
                x = (good[cast].sum() + quality.PSEUDO * start[0]) / (good.sum() + quality.PSEUDO)
                y = ((1 - good)[cast].sum() + quality.PSEUDO * start[1]) / ((1 - good).sum() + quality.PSEUDO)
                if vote == -1 and x > y or vote == 1 and x < y:
                    x = y = (x + y) / 2
                up[cast] *= x
                down[cast] *= y
        good = up / (up + down)
    return good


def test_posterior_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    votes = {r.doc_id: r.v for r in quality._voted(docs, ["doc_id"]).select("doc_id", F.array(*(f"_v_{k}" for k in quality.RULES)).alias("v")).collect()}
    ids = sorted(votes)
    want = dict(zip(ids, brute_posterior(np.array([votes[i] for i in ids]))))
    for r in quality.assess(docs).collect():
        assert abs(r.posterior - want[r.doc_id]) < 1e-6 and r.kept == (not r.base_failed and want[r.doc_id] >= 0.5)


def test_chances_are_learned():
    rnd, seen = random.Random(3), {}
    table = {True: ((0.01, 0.0), (0.02, 0.1), (0.3, 0.5)), False: ((0.7, 0.0), (0.6, 0.02), (0.35, 0.1))}
    for _ in range(20_000):
        own = table[rnd.random() < 0.7]
        votes = tuple(-1 if (x := rnd.random()) < bad else 1 if x < bad + good else 0 for bad, good in own)
        seen[votes] = seen.get(votes, 0) + 1
    share, chances = quality.estimate([*seen.items()])
    assert abs(share - 0.7) < 0.04
    for r, own in enumerate(chances):
        for vote in (-1, 1):
            for side, kind in enumerate((True, False)):
                assert abs(own[vote][side] - table[kind][r][vote > 0]) < 0.05
