"""Documents whose sets of five-word shingles have a Jaccard similarity of ``LEAST`` or more, joined by count-vector R-trees.

A set becomes a point: its shingles are hashed into groups, one for about ``SHARE`` shingles, and a coordinate counts those of
one group; sets of other sizes are compared on the coarser of their groupings. Two sets share at most the sum of the coordinates' minima, and likewise everything below two nodes of the tree at most that of the
nodes' greatest counts; a pair, or two subtrees, whose bound is too small for the similarity is passed over. What is left
is verified on the whole sets.

One tree over all points would meet nearly every other one near its root, so points are dealt out first, and without loss:
under one order of all shingles, similar sets share one among their first ``n - ceil(0.8 n) + 1``. Sets that share such a
shingle and are of about one size form a group, and groups with the same smallest member are one. Shingles that more than ``CROWD`` sets have among
their first come last in the order (the ``HOT`` most frequent of them, so that the list has a bound), and the sets they
were taken from are dealt again: a passage shared by a third of all documents gathers no one. The order decides how much work
there is, never the result. Groups are cut into blocks of bounded size, and many small ones make one task's work.

Trees over counts come first and mark the sets that have a possible partner; only their shingles are fetched. Then trees
with the sets at hand verify, and each task gives the links of a spanning forest, not all pairs: components stay whole.

Edge cases: null and blank texts have an empty set and link with nothing, copies of one another included; fewer words than
a shingle count as one; texts of any length are used whole; rows alike in text or id share a component; null ids are carried,
and a component's id is its smallest that isn't null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, bounded, drop_staged, ship_package, staged, text_chunks
from .components import connected_components
from .near_copies import LEAST, SHINGLE, set_hash, shingle_set

SHARE, GROUPS, LEAF = 8, (64, 8_192), 16
CROWD, HOT = 256, 200_000
#: Sets of a block whose counts are joined in one task; rows of one task; shingles of a block or a task that verifies.
BLOCK, BAG, WEIGHT = 2_048, 20_000, 500_000
#: Rows of one long up to which a side of a join is broadcast: 16 MB of numbers.
NUMBERS = 2_000_000


def grouping(n: int) -> int:
    """The number of groups of a set of ``n``, a power of two; similar sets' numbers are equal or neighbours."""
    return min(max(1 << max(0, (n - 1) // SHARE).bit_length(), GROUPS[0]), GROUPS[1])


def counts(found: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector if len(vector) == groups else vector.reshape(-1, groups).sum(0, dtype=np.int32)


def prefix_size(n: int) -> int:
    """So many shingles, first in any common order, of which similar sets share one."""
    return n + LEAST[0] * n // -LEAST[1] + 1 if n else 0


def leading(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order by frequency class, then hash, without those that its order by hash alone gave."""
    last = np.isin(found, hot, assume_unique=True)
    known = int((~last[: prefix_size(len(found))]).sum())
    return np.concatenate([found[~last], found[last]])[known : prefix_size(len(found))]


class CountTree:
    """An R-tree over count vectors, packed top-down by halves along the widest coordinate."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.vectors, self.sizes = vectors, sizes
        self.order = np.arange(len(sizes))
        span, child = [(0, len(sizes))], []
        at = 0
        while at < len(span):
            a, b = span[at]
            if b - a <= LEAF:
                child.append(-1)
            else:
                part = self.order[a:b]
                wide = np.ptp(vectors[part], axis=0)
                by = vectors[part, wide.argmax()] if wide.max() > np.ptp(sizes[part]) else sizes[part]
                half = (b - a) // 2
                self.order[a:b] = part[np.argpartition(by, half)]
                child.append(len(span))
                span += [(a, a + half), (a + half, b)]
            at += 1
        self.span, self.child = span, np.array(child)
        inside = [self.order[a:b] for a, b in span]
        self.most = np.stack([vectors[i].max(0) for i in inside])
        self.low = np.array([sizes[i].min() for i in inside])

    def joined(self):
        """(i, js, may): for each leaf its points, the points of leaves not before it, and which pairs' bounds suffice."""
        for leaf in np.flatnonzero(self.child < 0):
            front, met = np.array([0]), []
            while len(front):
                shared = np.minimum(self.most[front], self.most[leaf]).sum(1)
                front = front[sum(LEAST) * shared >= LEAST[0] * (self.low[front] + self.low[leaf])]
                ends = self.child[front] < 0
                met.append(front[ends & (front >= leaf)])
                front = (self.child[front[~ends]][:, None] + np.arange(2)).ravel()
            own = self.order[slice(*self.span[leaf])]
            others = np.concatenate([self.order[slice(*self.span[k])] for part in met for k in part] or [own[:0]])
            if not len(others):
                continue
            shared = np.stack([np.minimum(self.vectors[others], self.vectors[i]).sum(1) for i in own])
            may = sum(LEAST) * shared >= LEAST[0] * (self.sizes[own][:, None] + self.sizes[others])
            yield own, others, may & (own[:, None] != others)


def met(vectors: list[np.ndarray], sizes: np.ndarray):
    """(i, js, may) of ``CountTree.joined`` for points of any groupings: each pair on the coarser of its two."""
    width = np.array([len(v) for v in vectors])
    for groups in np.unique(width):
        rows = np.flatnonzero((width == groups) | (width == 2 * groups))
        fine = width[rows] != groups
        for own, others, may in CountTree(np.stack([folded(vectors[i], groups) for i in rows]), sizes[rows]).joined():
            yield rows[own], rows[others], may & ~(fine[own][:, None] & fine[others])


def possible(vectors: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Which points have a partner by the bound; with ``side``, on the other side."""
    out = np.zeros(len(sizes), bool)
    for own, others, may in met(vectors, sizes):
        if side is not None:
            may = may & (side[own][:, None] != side[others])
        out[own] |= may.any(1)
        out[others] |= may.any(0)
    return out


def forest(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what pairs of similar sets connect, beyond what equal labels say."""
    size = np.array([len(s) for s in sets])
    words = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    label, out = np.unique(label, return_inverse=True)[1], []
    held = np.zeros(int(size.sum()), bool)
    for own, others, may in met([counts(s, grouping(len(s))) for s in sets], size):
        for i, row in zip(own.tolist(), may):
            js = others[row & (label[others] != label[i])]
            if not len(js):
                continue
            held[words[i]] = True
            shared = np.add.reduceat(held[np.concatenate([words[j] for j in js])].astype(np.int64), np.cumsum(size[js]) - size[js])
            held[words[i]] = False
            near = js[sum(LEAST) * shared >= LEAST[0] * (size[js] + size[i])]
            if len(near):
                groups, first = np.unique(label[near], return_index=True)
                out += [(i, int(j)) for j in near[first]]
                label[np.isin(label, groups)] = label[i]
    return out


def _groups(table, *by: str):
    """Row numbers of each group of a task's rows, by columns of longs."""
    keys = np.stack([table.column(c).to_numpy() for c in by])
    order = np.lexsort((table.column("fp").to_numpy(), *keys[::-1]))
    ends = np.flatnonzero((np.diff(keys[:, order], axis=1) != 0).any(0)) + 1
    return np.split(order, ends)


def _mark(bag):
    import pyarrow as pa

    vectors = [np.frombuffer(v, np.int32) for v in bag.column("counts").to_pylist()]
    n, p, q, own = (bag.column(c).to_numpy() for c in ("n", "p", "q", "own"))
    keep = np.zeros(len(n), bool)
    for rows in _groups(bag, "pivot", "p", "q"):
        if len(rows) > 1:
            side = own[rows] if p[rows[0]] != q[rows[0]] else None
            keep[rows] = possible([vectors[i] for i in rows], n[rows], side)
    return bag.select(["pivot", "fp"]).filter(pa.array(keep))


def _connect(bag):
    import pyarrow as pa

    fp, label, raw, out = bag.column("fp").to_numpy(), bag.column("label").to_numpy(), bag.column("set").to_pylist(), []
    for rows in _groups(bag, "pivot", "p", "q"):
        if len(rows) > 1:
            out += [(fp[rows[a]], fp[rows[b]]) for a, b in forest([np.frombuffer(raw[i], np.uint64) for i in rows], label[rows])]
    found = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _rows(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("sig"), text.alias("text"))


def _each_set(rows: DataFrame, schema: str, columns) -> DataFrame:
    """Rows (doc_id, sig, text) through ``columns``: for a run of ids, sigs and sets of shingles, the columns of ``schema``."""

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            low = 0
            for ids, buf, offsets in text_chunks(batch):
                raw = buf.tobytes()
                sets = [shingle_set(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(columns(pa, ids, batch.column("sig").slice(low, len(sets)), sets), names=names)
                low += len(sets)

    return rows.mapInArrow(run, schema)


def _lists(pa, arrays):
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def marks(documents: DataFrame) -> DataFrame:
    """doc_id, sig (a hash of the text), fp (of its set), n (shingles), keys (the first of them), counts."""

    def columns(pa, ids, sigs, sets):
        first = [s[: prefix_size(len(s))] for s in sets]
        return [ids, sigs, pa.array(map(set_hash, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), _lists(pa, first), pa.array([counts(s, grouping(len(s))).tobytes() for s in sets], pa.binary())]

    return _each_set(_rows(documents), "doc_id long, sig long, fp long, n long, keys array<long>, counts binary", columns)


def _representatives(documents: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``best`` (struct of doc_id and sig) names."""
    named = best.select(F.coalesce("best.doc_id", F.lit(NO_ID)).alias("_id"), F.col("best.doc_id").isNull().alias("none"), F.col("best.sig").alias("sig"))
    keyed = _rows(documents).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("none", F.col("doc_id").isNull())
    return keyed.join(bounded(named), ["_id", "none", "sig"], "left_semi").select("doc_id", "sig", "text")


def _dealt(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """pivot, fp: groups of sets (of ``distinct``) among which every similar pair stands together in one at least."""
    keyed = distinct.select("fp", "n", F.explode("keys").alias("key"))
    found = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    apart = LEAST[1] * F.col("low") < LEAST[0] * F.col("high")  # two sets of sizes too different
    found = staged(found.filter((F.col("m") > 2) | ((F.col("m") == 2) & ~apart)).select("key", "m"), "shared-shingles")
    used = [found]
    hot = [r.key for r in found.filter(F.col("m") > CROWD).orderBy(F.desc("m"), "key").limit(HOT).collect()]  # at most HOT numbers
    if hot:
        late = documents.sparkSession.createDataFrame([(k,) for k in hot], "key long")
        redealt = distinct.join(keyed.join(F.broadcast(late), "key", "left_semi").select("fp").distinct(), "fp", "left_semi")
        numbers = np.sort(np.array(hot, np.int64).view(np.uint64))
        more = _each_set(_representatives(documents, redealt), "fp long, n long, keys array<long>", lambda pa, ids, sigs, sets: [pa.array(map(set_hash, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), _lists(pa, [leading(s, numbers) for s in sets])])
        more = staged(more.select("fp", "n", F.explode("keys").alias("key")).distinct(), "later-shingles")
        keys = found.join(F.broadcast(late), "key", "left_anti").select("key").union(more.select("key")).distinct()
        keys = staged(keys, "keys")
        used += [more, keys]
        old = keyed.join(F.broadcast(late), "key", "left_anti").join(bounded(keys, NUMBERS), "key", "left_semi")
        met = old.select("key", "fp", "n").union(more.select("key", "fp", "n"))
    else:
        met = keyed.join(bounded(found.select("key"), NUMBERS), "key", "left_semi").select("key", "fp", "n")
    # sizes of similar sets differ by less than one step: each is with its own step and with the next
    step = F.floor(F.log("n") / F.log(F.lit(LEAST[1] / LEAST[0] + 0.01)))
    met = staged(met.select("key", "fp", F.explode(F.array(step, step + 1)).alias("step")), "met")
    used.append(met)
    met = met.repartition("key", "step")
    pivots = met.groupBy("key", "step").agg(F.min("fp").alias("pivot"), F.count("*").alias("m")).filter("m > 1").select("key", "step", "pivot")
    groups = staged(met.join(pivots, ["key", "step"]).select("pivot", "fp").distinct(), "groups")
    for frame in used:
        drop_staged(groups.sparkSession, frame)
    return groups


def _in_blocks(groups: DataFrame, weight, limit: int) -> DataFrame:
    """``groups`` with the number of blocks of each group and the block of each member."""
    sizes = staged(groups.groupBy("pivot").agg(F.ceil(F.sum(weight) / limit).cast("long").alias("blocks")), "sizes")
    return groups.join(bounded(sizes), "pivot").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))


def _bagged(rows: DataFrame, weight, limit: int) -> DataFrame:
    """``rows`` with a bag: whole (pivot, p, q) groups dealt into tasks of about ``limit``."""
    bags = max(1, -(-int(rows.agg(F.sum(weight)).first()[0] or 0) // limit))
    return rows.withColumn("bag", F.pmod(F.xxhash64("pivot", "p", "q"), F.lit(bags)))


def links(documents: DataFrame, distinct: DataFrame, first_keys: DataFrame, repeated: bool = True) -> DataFrame:
    """a, b: links between fps (of ``distinct``: fp, best, n, counts) that connect all similar sets; whether rows may be repeated.

    ``first_keys`` (fp, best, n, keys; staged) is deleted once the groups are dealt: it is most of what lies on the disk.
    """
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    two = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    groups = _dealt(documents, first_keys)
    drop_staged(documents.sparkSession, first_keys)
    dealt = _in_blocks(groups, F.lit(1), BLOCK).withColumn("other", F.explode(every)).select("pivot", *two, "own", "fp")
    bags = _bagged(staged(dealt, "dealt"), F.lit(1), BAG).join(distinct.select("fp", "n", "counts"), "fp")
    pairs = bags.groupBy("bag").applyInArrow(_mark, "pivot long, fp long").distinct()
    pairs = staged(pairs.join(distinct.select("fp", "n"), "fp"), "possible")
    same = pairs.groupBy("pivot").agg(F.count("*").alias("m"), F.min("fp").alias("low"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum("n").alias("weight"))
    pairs = pairs.join(bounded(staged(same.groupBy("m", "low", "x", "weight").agg(F.min("pivot").alias("pivot")).select("pivot"), "kept-groups")), "pivot")  # groups of the same sets once

    wanted = distinct.join(bounded(pairs.select("fp").distinct()), "fp", "left_semi")
    sets = _each_set(_representatives(documents, wanted), "fp long, set binary", lambda pa, ids, sigs, sets: [pa.array(map(set_hash, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())])
    sets = staged(sets.dropDuplicates(["fp"]) if repeated else sets, "shingle-sets")
    blocked = staged(_in_blocks(pairs, F.col("n"), WEIGHT), "blocked")
    lead = blocked.groupBy("pivot").agg(F.min("fp").alias("lead"))
    everywhere = F.when(F.col("fp") == F.col("lead"), every).otherwise(F.array("own"))
    first = blocked.join(bounded(lead), "pivot").withColumn("p", F.explode(everywhere)).select("pivot", "p", F.col("p").alias("q"), "fp", "n", F.col("fp").alias("label"))
    found = staged(_verified(first, sets), "links")
    large = blocked.filter("blocks > 1")
    if not large.limit(1).count():
        return found
    roots = staged(connected_components(found), "first-roots")
    large = large.join(roots, large.fp == roots.node, "left").select("pivot", "blocks", "own", "fp", "n", F.coalesce("root", "fp").alias("label"))
    apart = large.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("pivot")
    rest = large.join(bounded(apart), "pivot", "left_semi").withColumn("other", F.explode(every)).filter("own <> other")
    return found.union(_verified(rest.select("pivot", *two, "fp", "n", "label"), sets)).distinct()


def _verified(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return _bagged(rows, F.col("n"), WEIGHT).join(sets, "fp").groupBy("bag").applyInArrow(_connect, "a long, b long").distinct()


def linked(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    ship_package(documents.sparkSession)
    marked = staged(marks(documents), "shingle-marks")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    some = marked.filter("n > 0").withColumn("best", row)
    several = staged(some.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min("best").alias("best")).filter("copies > 1"), "copies")
    numbers = bounded(several.select("fp"), NUMBERS)
    alone = some.join(numbers, "fp", "left_anti").select("fp", "best", F.col("doc_id").alias("low"), F.lit(1).cast("long").alias("copies"), "n", "keys", "counts")
    # of copies the first row; rows alike in id and text are alike in all of these
    same = some.join(bounded(several.withColumnRenamed("best", "first")), "fp").filter("best = first").dropDuplicates(["fp"])
    distinct = alone.union(same.select("fp", "best", "low", "copies", "n", "keys", "counts"))
    first_keys = staged(distinct.select("fp", "best", "n", "keys"), "first-keys")
    distinct = staged(distinct.drop("keys"), "distinct-sets")
    repeated = bool(marked.groupBy("doc_id", "sig").count().filter("count > 1").limit(1).count())
    rows = staged(marked.select("doc_id", "fp", "n"), "rows")
    drop_staged(documents.sparkSession, marked)
    roots = staged(connected_components(links(documents, distinct, first_keys, repeated)), "roots")
    owner = distinct.select("fp", "low", "copies").join(roots, distinct.fp == roots.node, "left")
    owner = staged(owner.filter("copies > 1 or root is not null").select("fp", "low", F.coalesce("root", "fp").alias("root")), "owners")
    smallest = owner.join(owner.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    result = rows.filter("n > 0").join(bounded(staged(smallest, "components")), "fp", "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return result.union(rows.filter("n = 0").select("doc_id", "n", "doc_id"))


LINKED_SQL = f"""
with recursive
words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w
  from documents
), sets as (
  select doc_id, case
    when coalesce(len(w), 0) = 0 then []
    when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))) end s
  from words
), postings as materialized (select doc_id, len(s) n, hash(g) h, g from (select doc_id, s, unnest(s) g from sets)),
links as materialized (
  select a.doc_id a, b.doc_id b from postings a join postings b on a.h = b.h and a.g = b.g and a.doc_id <> b.doc_id
  where 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))
), reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a)
select doc_id, len(s)::bigint n_shingles, least(doc_id, (select min(b) from reached where a = doc_id)) component_id
from sets
"""
