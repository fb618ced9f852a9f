"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Every vector keeps an upper bound on the distance to its centroid, lower bounds for its several nearest other centroids,
and one lower bound for all the rest. After centroids move, bounds move by as much. A centroid whose lower bound lies
above the upper bound can't be the nearest; only the others are measured again, exactly, and all of them where the
remainder bound no longer certifies the rest. How many bounds are kept adapts: between an eighth and a quarter of the
centroids, as many as the last round needed.

Distances are exact integers; bounds are rounded to the safe side, and only a strict gap certifies, so that ties go to
the smaller number as a full search decides them. Vectors stay where they are: a round maps over them, sums of each
cluster are made within batches first, and only centroids (``k`` by the number of components) pass through the driver.

Edge cases: vectors of another length, or with a null, NaN or infinite component, are left out; so the result may be
empty. With fewer vectors than ``k`` each is a centroid. Null ids are assigned but don't start a centroid; repeated rows
are separate vectors. Components beyond ``WIDEST`` after scaling have no exact 64-bit distance: such vectors are returned
with null cluster, distance and inertia. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_staged, ship_package, staged

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Beyond this a squared distance of 64 components may pass 63 bits; up to ``EXACT`` doubles are exact as well.
WIDEST, EXACT = 1 << 27, 1 << 22
STATE = "vec_id long, x array<long>, cluster int, distance long, upper double, near array<int>, lower array<float>, rest double, n long, needed int"


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``c``, exact."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT else np.int64
    a, b = x.astype(kind), c.astype(kind)
    if kind == np.float64:  # the differences' squares and the three parts of their sum stay below 2 ** 53
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)


def _below(v):
    return np.nextafter((v * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def full_search(x: np.ndarray, c: np.ndarray, keep: int):
    """cluster, distance, upper, near, lower, rest from all distances."""
    d = distances(x, c)
    order = np.argsort(d, 1, kind="stable")  # ties: smaller number
    rows = np.arange(len(x))[:, None]
    first = order[:, 0]
    near = order[:, 1 : 1 + keep]
    root = np.sqrt(d.astype(np.float64))
    rest = root[rows[:, 0], order[:, 1 + keep]] * (1 - 1e-12) if d.shape[1] > 1 + keep else np.full(len(x), np.inf)
    return first.astype(np.int32), d[rows[:, 0], first], root[rows[:, 0], first] * (1 + 1e-12), near.astype(np.int32), _below(root[rows, near]), rest


def adjust(x, c, moved, cluster, upper, near, lower, rest, keep):
    """The same after centroids moved to ``c``, each by ``moved``; also how many bounds a vector needed at most."""
    upper = (upper + moved[cluster]) * (1 + 1e-12)
    lower = np.nextafter((lower - moved[near]).astype(np.float32), np.float32(-np.inf))
    rest = rest - moved.max(initial=0) * (1 + 1e-12)
    open_ = lower <= upper[:, None]
    lost = rest <= upper
    some = np.flatnonzero(open_.any(1) & ~lost)
    need = int(open_[some].sum(1).max(initial=0))
    cluster, near = cluster.copy(), near.copy()
    for j in range(near.shape[1]):  # by place among the bounds: measured only for vectors where it is open
        at = some[open_[some, j]]
        if not len(at):
            continue
        own, other = cluster[at], near[at, j]
        mine, theirs = (((x[at] - c[k]) ** 2).sum(1) for k in (own, other))
        swap = (theirs < mine) | ((theirs == mine) & (other < own))
        cluster[at], near[at, j] = np.where(swap, other, own), np.where(swap, own, other)
        upper[at] = np.sqrt(np.minimum(mine, theirs)) * (1 + 1e-12)
        lower[at, j] = _below(np.sqrt(np.maximum(mine, theirs)))
    again = np.flatnonzero(lost)
    if near.shape[1] > keep:  # bounds that are dropped join the rest
        order = np.argsort(lower, 1, kind="stable")
        rows = np.arange(len(x))[:, None]
        near, lower = near[rows, order], lower[rows, order]
        rest = np.minimum(rest, lower[:, keep].astype(np.float64))
        near, lower = near[:, :keep].copy(), lower[:, :keep].copy()
    if len(again):
        cluster[again], _, upper[again], near[again], lower[again], rest[again] = full_search(x[again], c, near.shape[1])
    distance = ((x - c[cluster]) ** 2).sum(1)
    return cluster, distance, upper, near, lower, rest, need


def _assigned(vectors: DataFrame, c: np.ndarray, moved: np.ndarray | None, keep: int) -> DataFrame:
    """STATE rows of all vectors, and for each batch a row a cluster (n is its number of vectors, x their sum, needed)."""

    def run(batches):
        import pyarrow as pa

        flat = lambda column, width: column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, need = flat(batch.column("x"), SIZE), 0
            if moved is None:
                cluster, distance, upper, near, lower, rest = full_search(x, c, keep)
            else:
                old = {k: batch.column(k).to_numpy(zero_copy_only=False).copy() for k in ("cluster", "upper", "rest")}
                width = len(batch.column("near").flatten()) // n
                near, lower = flat(batch.column("near"), width), flat(batch.column("lower"), width)
                cluster, distance, upper, near, lower, rest, need = adjust(x, c, moved, old["cluster"], old["upper"], near, lower, old["rest"], keep)
            blank = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), lists(near, pa.int32()), lists(lower, pa.float32()), pa.array(rest), blank(pa.int64(), n), blank(pa.int32(), n)], names=names)
            held = np.unique(cluster)
            sums = np.stack([x[cluster == k].sum(0) for k in held])
            m = len(held)
            yield pa.RecordBatch.from_arrays([blank(pa.int64(), m), lists(sums, pa.int64()), pa.array(held, pa.int32()), blank(pa.int64(), m), blank(pa.float64(), m), blank(pa.list_(pa.int32()), m), blank(pa.list_(pa.float32()), m), blank(pa.float64(), m), pa.array(np.bincount(cluster)[held], pa.int64()), pa.array(np.full(m, need), pa.int32())], names=names)

    names = [f.split()[0] for f in STATE.split(", ")]
    return vectors.mapInArrow(run, STATE)


def prepared(embeddings: DataFrame, scale: int = SCALE, size: int = SIZE) -> DataFrame:
    """vec_id, x (integer components), fits: the vectors with ``size`` components, all of them finite."""
    part = lambda f: F.col("embedding").isNotNull() & (F.size("embedding") == size) & f
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = embeddings.filter(part(finite)).select(F.col("vec_id").cast("long"), x.alias("x"))
    return rows.withColumn("fits", F.forall("x", lambda v: v.between(-WIDEST, WIDEST)))


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    ship_package(spark)
    vectors = staged(prepared(embeddings, scale), "vectors")
    inside, outside = vectors.filter("fits").select("vec_id", "x"), vectors.filter("not fits")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = inside.filter("vec_id is not null").orderBy(drawn, "vec_id", "x").limit(k).collect()
    lost = outside.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    if not first:
        return lost
    c, state, moved = np.array([r.x for r in first], np.int64), inside, None
    least, keep = max(1, len(c) // 8), max(1, len(c) // 4)
    for number in range(rounds + 1):
        new = staged(_assigned(state, c, moved, keep), "assigned")
        if state is not inside:
            drop_staged(spark, state)
        state = new.filter("n is null")
        if number == rounds:
            break
        sums = new.filter("n is not null").select("cluster", "n", "needed", F.posexplode("x").alias("at", "v"))
        # k times the number of components: as large as the centroids
        sums = sums.groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"), F.max("needed").alias("needed")).collect()
        before, c = c, c.copy()
        for r in sums:
            c[r.cluster, r.at] = int(r.v) // r.n
        moved = np.sqrt(((c - before) ** 2).sum(1).astype(np.float64)) * (1 + 1e-12)
        if number:
            keep = min(keep, max(least, max(r.needed for r in sums)))
    totals = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    held = lambda v: v if v < 1 << 63 else None
    rows = [(j, held(d), held(sum(totals.values())), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, d in totals.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(lost.columns).union(lost)  # facts: k rows


def cluster_sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> str:
    """The same in DuckDB, by measuring every distance in every round."""
    out = [
        f"v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) x from embeddings "
        f"where len(embedding) = {SIZE} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {SIZE})",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), vec_id, x) - 1 j, x from v order by j limit {k})",
    ]
    for n in range(rounds + 1):
        out.append(f"d{n} as materialized (select r, vec_id, v.x, j, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from v, c{n} c)")
        out.append(f"a{n} as materialized (select r, arg_min(j, (d, j)) j, min(d) d, any_value(vec_id) vec_id, any_value(x) x from d{n} group by r)")
        if n < rounds:
            parts = f"select j, unnest(x) v, unnest(range({SIZE})) i from a{n}"
            mean = "case when s >= 0 then s // m else -((-s + m - 1) // m) end"
            out.append(f"m{n} as (select j, list({mean} order by i) x from (select j, i, sum(v)::bigint s, count(*) m from ({parts}) group by j, i) group by j)")
            out.append(f"c{n + 1} as materialized (select c.j, coalesce(m.x, c.x) x from c{n} c left join m{n} m using (j))")
    return (
        f"with {', '.join(out)} select vec_id, j::int as cluster, d distance, sum(d) over (partition by j)::bigint cluster_inertia, sum(d) over ()::bigint inertia, "
        f"sha256(array_to_string(c.x, ',')) centroid_sha256 from a{rounds} a join c{rounds} c using (j)"
    )


CLUSTER_SQL = cluster_sql()
