"""Merkle manifest, centroid clustering and n-gram join against brute force, with edges."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from credsift.llm import centroids, jaccard_join, merkle

EXTRA = "grp string, hash string, place long, size long, part int, fp long, key long, sig long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
CLASH = ("g", "h", 1, 2, 3, 4, 5, 6)


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(enc(v) for v in (r[0], r[3], r[2], r[4], t))
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, k in enumerate(at):
                low = k // 8 * 8
                paths[p].append((nodes[low:k], nodes[k + 1 : low + 8]))
                at[p] = k // 8
            nodes = [sha(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made[g] = (own, *tree([leaf(r, r[1]) for r in own]))
    root, tops = tree([made[g][1] for g in names])
    out = []
    for g, above in zip(names, tops):
        own, subroot, paths = made[g]
        for r, path in zip(own, paths):
            first = leaf(r, r[1])
            at = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else first
            for left, right in path + above:
                at = sha([*left, at, *right])
            out.append((r[0], first, subroot, root, sha(h for left, right in path + above for h in left + right), at, at == root))
    return sorted(map(repr, out))


def manifest_rows(df):
    return sorted(repr(tuple(r)) for r in merkle.manifest(df).collect())


def test_manifest_equals_a_tree_built_by_hand(spark):
    rnd = random.Random(4)
    text = lambda: rnd.choice([None, "", "Ab", "é" * rnd.randrange(9), "lower only"])
    rows = [(i, text(), rnd.choice(["fr", "", "é", None]), None if i % 7 else "s", i, *CLASH) for i in range(300)]
    rows += [(i, "Many" * (i % 5), "en", "s", 1, *CLASH) for i in range(300, 5_100)]  # more than a block of 4,096
    rows += [(None, "No id", "en", None, None, *CLASH)] * 3 + [rows[5]] * 10 + [(9_000, "x" * 300_000 + "Y", "alone", "s", 1, *CLASH)]
    rnd.shuffle(rows)
    assert manifest_rows(spark.createDataFrame(rows, DOCS).repartition(5)) == brute_manifest(rows)


def test_small_manifests(spark):
    one = [(3, None, None, None, None, *CLASH)]
    assert manifest_rows(spark.createDataFrame(one, DOCS)) == brute_manifest(one)
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
    many = [(i, "T", f"l{i % 70}", "s", 1, *CLASH) for i in range(150)]  # groups enough for three levels above them
    assert manifest_rows(spark.createDataFrame(many, DOCS).repartition(7)) == brute_manifest(many)


@pytest.mark.parametrize("first,count,size", [(0, 100, 100), (5, 60, 700), (8, 8, 700), (63, 1, 64), (448, 252, 700), (0, 1, 1), (512, 3, 515)])
def test_subtrees_end_where_siblings_are_missing(first, count, size):
    leaves = [f"{i:064x}" for i in range(size)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    ends = merkle.climb(first, leaves[first : first + count], size, 4)
    assert all(levels[level][place] == h for level, place, h in ends)
    covered = sorted(i for level, place, _ in ends for i in range(place * 8**level, min((place + 1) * 8**level, size)))
    assert covered == list(range(first, first + count))


def brute_clusters(rows, k, rounds=5):
    kept = [(i, [int(np.floor(256 * float(v))) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    starts = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:k]
    c, x = np.array([s[1] for s in starts]), np.array([r[1] for r in kept])
    for n in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if n < rounds:
            c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    best = d.min(1)
    return sorted(repr((kept[i][0], int(a[i]), int(best[i]), int(best[a == a[i]].sum()), int(best.sum()), hashlib.sha256(",".join(map(str, c[a[i]].tolist())).encode()).hexdigest())) for i in range(len(kept)))


@pytest.mark.parametrize("k,n,spread", [(40, 600, 3), (1, 9, 1), (2, 50, 1), (9, 400, 2000), (40, 5, 1)])
def test_clusters_equal_a_full_search(spark, k, n, spread):
    rng = np.random.default_rng(k + n)
    rows = [(i, (rng.integers(-2, 3, 64) * spread / 256 + (i % 5)).tolist()) for i in range(n)]  # coarse: ties and repeated vectors
    rows += [(None, rows[0][1]), rows[1], rows[1], (-1, None), (-2, [1.0] * 63), (-3, [float("nan")] * 64), (-4, [None] * 64), (-5, [float("-inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    assert sorted(repr(tuple(r)) for r in centroids.cluster(df, k).collect()) == brute_clusters(rows, k)


def test_bounds_hold_and_adapt():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 30, (200, 64)) for m in rng.normal(0, 200, (12, 64))]).round().astype(np.int64)
    c = x[rng.choice(len(x), 24, replace=False)].copy()
    state, keep, rescans = centroids.full_search(x, c, 6), 6, []
    for _ in range(8):
        a = state[0]
        new = np.array([x[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(len(c))])
        moved, c = np.sqrt(((new - c) ** 2).sum(1)), new
        cluster, _, upper, near, lower, rest, need = centroids.adjust(x, c, moved, state[0], state[2], state[3], state[4], state[5], keep)
        exact = np.sqrt(centroids.distances(x, c))
        rows = np.arange(len(x))
        assert (cluster == exact.argmin(1)).all() and (upper >= exact[rows, cluster]).all()
        assert (lower <= np.take_along_axis(exact, near.astype(int), 1)).all()
        outside = exact.copy()
        outside[rows, cluster] = np.inf
        np.put_along_axis(outside, near.astype(int), np.inf, 1)
        assert (rest <= outside.min(1)).all()
        state, keep = (cluster, None, upper, near, lower, rest), min(keep, max(3, need))
        rescans.append(near.shape[1])
    assert rescans[-1] < rescans[0]


def test_clusters_on_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, [0.5] * 64), (2, [3e30] + [0.0] * 63)]
    got = {r.vec_id: r.cluster for r in centroids.cluster(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: 0, 2: None}


def brute_links(rows):
    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            low[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(repr((d, len(s), d if not s else least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 6)))
    passage = [word() for _ in range(25)]
    texts = []
    for base in range(12):
        words = [word() for _ in range(rnd.randrange(1, 90))]
        if base % 3 == 0:
            words = words[:30] + passage + words[30:]
        for copy in range(rnd.choice([1, 2, 9])):
            own = list(words)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    core = [word() for _ in range(120)]
    for copy in range(40):  # a large group of near copies, some at the threshold
        own = list(core)
        for _ in range(rnd.randrange(1, 4)):
            own[rnd.randrange(len(own))] = word()
        texts.append(" ".join(own).upper() if copy % 5 == 0 else "\n".join(own))
    texts += [" ".join(passage + [word() for _ in range(k)]) for k in (0, 3, 60, 61, 62)] + [None, "", " \t", "One two", "one TWO", "a b c d e", texts[0], texts[0]]
    return [(None if k % 17 == 5 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("limits", [{}, {"CROWD": 3, "BLOCK": 4, "BAG": 20, "WEIGHT": 300}, {"CROWD": 2, "HOT": 7, "BLOCK": 3, "WEIGHT": 150}])
def test_join_equals_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_rows(len(limits))
    df = spark.createDataFrame([(i, t, "l", "s", 1, *CLASH) for i, t in rows], DOCS).repartition(3)
    assert sorted(repr(tuple(r)) for r in jaccard_join.linked(df).collect()) == brute_links(rows)


def test_join_on_edges(spark):
    assert jaccard_join.linked(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.linked(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_neighbouring_sizes_have_neighbouring_groupings():
    for n in range(1, 60_000, 7):
        assert jaccard_join.grouping(-(-5 * n // 4)) in (jaccard_join.grouping(n), 2 * jaccard_join.grouping(n))


def test_no_pair_is_lost_to_the_tree():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(1, 1500), dtype=np.uint64)
        sets += [np.unique(np.where(rng.random(len(base)) < share, rng.integers(0, 1 << 63, len(base), dtype=np.uint64), base)) for share in (0, 0.05, 0.1, 0.3)]
    similar = {(i, j) for i, j in combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    vectors = [jaccard_join.counts(s, jaccard_join.grouping(len(s))) for s in sets]
    joined = jaccard_join.met(vectors, np.array([len(s) for s in sets]))
    met = {(min(own[a], others[b]), max(own[a], others[b])) for own, others, may in joined for a, b in np.argwhere(may)}
    assert similar <= met and len(met) < len(sets) ** 2 / 8 and len({len(v) for v in vectors}) > 1
    for i, j in similar:
        first = [set(s[: jaccard_join.prefix_size(len(s))].tolist()) for s in (sets[i], sets[j])]
        assert first[0] & first[1]
