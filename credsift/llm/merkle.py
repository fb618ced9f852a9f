"""Merkle manifest of a dataset: a tree for each group (language), a tree over the groups' roots, and a proof for every row.

Leaves are sorted by range over partitions. Counts of each group in each partition give offsets, so every leaf knows its
place in its group without a sort in one task. Where a partition holds a whole aligned run of ``FAN`` nodes, the run is
hashed there, up to ``LEVELS`` levels; the ragged nodes at its ends are shuffled by their coordinate (group, level,
place), where their siblings meet, and upper levels are finished in the same way, one small aggregation a level. Going
down again, each aligned block of leaves gets its siblings on the way to the root; the rest of a proof lies in the block.

No group is held by one task: a block has ``FAN ** LEVELS`` leaves at most and a run has ``FAN`` nodes.

Edge cases: null values are hashed as ``-``, a null group or id sorts first; rows with equal ids are ordered by their
leaves, and equal leaves are interchangeable; empty and very long texts are hashed whole; a null id is never tampered
with; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bounded, ship_package, staged

FAN, LEVELS = 8, 4
PATH = "array<struct<left:string,right:string>>"
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _encoded(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(**columns: Column) -> Column:
    """The digest of a row: each value as ``-`` if null, else its UTF-8 length, a colon and the value."""
    return F.sha2(F.concat(*(_encoded(columns.get(c, F.col(c))) for c in LEAF)), 256)


def _digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes of a level in a tree of ``size`` leaves."""
    return -(-size // FAN**level)


def climb(first: int, hashes: list[str], size: int, levels: int):
    """From the neighbouring leaves ``first``.. of a tree: (level, place, hash) of every node whose parent can't be made of them."""
    out = []
    for level in range(levels):
        n, end = width(size, level), first + len(hashes)
        if n == 1:
            break
        low = -(-first // FAN) * FAN
        high = end if end == n else end // FAN * FAN
        if low >= high:
            break
        out += [(level, i, hashes[i - first]) for i in (*range(first, low), *range(high, end))]
        hashes = [_digest(hashes[i - first : min(i + FAN, high) - first]) for i in range(low, high, FAN)]
        first = low // FAN
    else:
        level = levels
    return out + [(level, first + i, h) for i, h in enumerate(hashes)]


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (with grp, never null) with place (from 0 in the group, by ``order``) and size of the group, range-sorted."""
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def rank(batches):
        import pyarrow as pa

        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("grp").to_pylist()
            starts = [i for i, g in enumerate(groups) if g != (groups[i - 1] if i else last)]
            place = np.arange(len(groups)) + count
            for a, b in zip(starts, [*starts[1:], len(groups)]):
                place[a:b] = np.arange(b - a)
            last, count = groups[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "rank"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", rank long"
    ranked = staged(ranged.mapInArrow(rank, schema), "ranked-leaves")
    counts = ranked.groupBy("grp", "part").agg(F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part")) - F.col("n")
    offsets = counts.select("grp", "part", before.alias("offset"), F.sum("n").over(group).alias("size"))
    return ranked.join(bounded(staged(offsets, "offsets")), ["grp", "part"]).select(*leaves.columns, (F.col("offset") + F.col("rank")).alias("place"), "size")


def _local(leaves: DataFrame, levels: int) -> DataFrame:
    """grp, size, level, place, hash of the nodes at which the subtrees that each partition can make alone end."""
    block = FAN**levels

    def run(batches):
        import pyarrow as pa

        def made(rows):
            out = [(rows[0][0], rows[0][1], *node) for node in climb(rows[0][2], [r[3] for r in rows], rows[0][1], levels)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["grp", "size", "level", "place", "hash"])

        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "size", "place", "hash"))):
                if held and (row[0] != held[0][0] or row[2] != held[-1][2] + 1 or row[2] // block != held[0][2] // block):
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    return leaves.select("grp", "size", "place", "hash").sortWithinPartitions("grp", "place").mapInArrow(run, "grp string, size long, level int, place long, hash string")


def _width(level: int) -> Column:
    return F.expr(f"(size + {FAN**level - 1}L) div {FAN**level}L")


def tree(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of numbered leaves: the roots (grp, root), and the paths (grp, block, path) from each aligned block of leaves to the root."""
    nodes = _local(leaves, levels) if levels else leaves.select("grp", "size", F.lit(0).alias("level"), "place", "hash")
    ends = staged(nodes, "subtree-ends")
    largest = ends.agg(F.max("size")).first()[0] or 1
    top = next(level for level in range(64) if width(largest, level) == 1)
    at = lambda level: ends.filter(F.col("level") == level).select("grp", "size", "place", "hash")
    run = F.expr(f"place div {FAN}L").alias("run")
    ordered = F.sort_array(F.collect_list(F.struct("place", "hash")))
    nodes, tops = at(0), None
    upper = {}
    for level in range(top + 1):
        if level >= levels:
            nodes = upper[level] = staged(nodes, "nodes")
        ended = nodes.filter((_width(level) == 1) & ((_width(level - 1) > 1) if level else F.lit(True))).select("grp", F.col("hash").alias("root"))
        tops = ended if tops is None else tops.union(ended)
        made = nodes.filter(_width(level) > 1).groupBy("grp", "size", run).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x.hash), ""), 256).alias("hash"))
        nodes = at(level + 1).union(made.select("grp", "size", F.col("run").alias("place"), "hash"))
    none = F.array().cast(PATH)
    low = min(levels, top)
    paths = None
    for level in range(top, low - 1, -1):
        here = upper.get(level)
        if here is None:  # every group ends below the blocks' level
            break
        alone = here.filter(_width(level) == 1).select("grp", "place", none.alias("path"))
        if paths is not None:
            runs = here.filter(_width(level) > 1).groupBy("grp", run).agg(ordered.alias("nodes"))
            own = runs.select("grp", "run", F.col("nodes.hash").alias("all"), F.posexplode("nodes").alias("i", "node"))
            side = F.struct(F.array_join(F.slice("all", 1, F.col("i")), "").alias("left"), F.array_join(F.slice("all", F.col("i") + 2, FAN), "").alias("right"))
            above = paths.select("grp", F.col("place").alias("run"), "path")
            alone = alone.union(own.join(above, ["grp", "run"]).select("grp", F.col("node.place").alias("place"), F.concat(F.array(side), "path").alias("path")))
        paths = staged(alone, "paths")
    roots = staged(tops, "roots")
    whole = roots.select("grp", F.lit(0).cast("long").alias("block"), none.alias("path"))
    if paths is not None:
        found = paths.select("grp", F.col("place").alias("block"), "path")
        whole = found.union(whole.join(found.select("grp").distinct(), "grp", "left_anti"))
    return roots, whole


def _prove(block, above):
    """Digests of one aligned block's leaves, from its nodes and its path to the root."""
    import pyarrow as pa

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = [pa.int64(), *[pa.string()] * 5]
    if not block.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    rows = sorted(zip(block.column("place").to_pylist(), *(block.column(c).to_pylist() for c in ("doc_id", "hash", "altered"))), key=lambda r: r[0])
    size = block.column("size")[0].as_py()
    subroot, root, path = (above.column(c)[0].as_py() for c in ("subroot", "root", "path"))
    steps = [(p["left"], p["right"]) for p in path]
    local, hashes = [], [r[2] for r in rows]
    while len(local) < LEVELS and width(size, len(local)) > 1:
        local.append(hashes)
        hashes = [_digest(hashes[i : i + FAN]) for i in range(0, len(hashes), FAN)]
    out = []
    for k, (_, doc_id, leaf, altered) in enumerate(rows):
        sides, at = [], k
        for nodes in local:
            low = at // FAN * FAN
            sides.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + FAN])))
            at //= FAN
        sides += steps
        folded = altered or leaf
        for left, right in sides:
            folded = _digest((left, folded, right))
        out.append((doc_id, leaf, subroot, root, _digest(s for side in sides for s in side), folded))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; groups are languages.

    ``folded_root`` goes from the row as a reader finds it (tampered with where 3 divides the crc32 of its id) along the
    original siblings; ``verified`` says whether it arrives at the root.
    """
    ship_package(documents.sparkSession)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    altered = F.when(changed, leaf_hash(text=F.translate(F.col("text").cast("string"), UPPER, LOWER)))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null first, then bytewise
    leaves = documents.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("hash"), altered.alias("altered"), F.monotonically_increasing_id().alias("row"))
    placed = numbered(staged(leaves, "leaves"), "doc_id", "hash", "row")
    subroots, paths = tree(placed)
    order = numbered(subroots.select(F.lit("").alias("grp"), F.col("root").alias("hash"), F.col("grp").alias("name")), "name")
    order = staged(order, "groups")
    root, group_paths = tree(order, 0)
    group = order.join(group_paths.select(F.col("block").alias("place"), F.col("path").alias("on")), "place").crossJoin(root.select("root"))  # one root
    group = group.select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "root", "on")
    above = paths.join(group, "grp").select("grp", "block", "subroot", "root", F.concat("path", "on").alias("path"))
    blocks = placed.withColumn("block", F.expr(f"place div {FAN**LEVELS}L")).select("grp", "block", "place", "size", "doc_id", "hash", "altered")
    proved = blocks.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(depth: int = 8, group_depth: int = 4) -> str:
    """The manifest in DuckDB, for up to ``FAN ** depth`` rows a group and ``FAN ** group_depth`` groups."""
    encoded = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(encoded(text if c == "text" else c) for c in LEAF) + ")"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda s: ascii(s)::bigint)), lambda c, b: "
        "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint)"
    )
    out = [
        f"raw as (select coalesce('=' || lang, '') g, doc_id, {leaf('text')} h, case when {crc} % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end altered from documents)",
        "l0 as (select g, row_number() over (partition by g order by doc_id nulls first, h) - 1 p, h, count(*) over (partition by g) n, doc_id, altered from raw)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            if k:
                out.append(f"{name}{k} as (select g, p // {FAN} p, case when max(n) > 1 then sha256(string_agg(h, '' order by p)) else max(h) end h, (max(n) + {FAN - 1}) // {FAN} n from {name}{k - 1} group by g, p // {FAN})")
            frame = f"over (partition by g, p // {FAN} order by p rows between"
            out.append(f"{name}s{k} as materialized (select g, p, n, coalesce(string_agg(h, '') {frame} unbounded preceding and 1 preceding), '') l, coalesce(string_agg(h, '') {frame} 1 following and unbounded following), '') r from {name}{k})")

    levels("l", depth)
    out.append(f"sub as (select g, h from l{depth - 1})")
    out.append("r0 as (select '' g, row_number() over (order by g) - 1 p, h, count(*) over () n, g name from sub)")
    levels("r", group_depth)
    out.append(f"w0 as (select l0.g, l0.doc_id, l0.h leaf, coalesce(altered, l0.h) f, '' proof, l0.p, r0.p q, sub.h subroot, (select h from r{group_depth - 1}) root from l0 join sub using (g) join r0 on r0.name = l0.g)")
    for step, (name, k) in enumerate([*(("l", k) for k in range(depth)), *(("r", k) for k in range(group_depth))]):
        place, match = ("p", "s.g = w.g and") if name == "l" else ("q", "")
        out.append(f"w{step + 1} as (select w.g, doc_id, leaf, case when s.n > 1 then sha256(s.l || f || s.r) else f end f, proof || s.l || s.r proof, w.p, q, subroot, root from w{step} w join {name}s{k} s on {match} s.p = w.{place} // {FAN**k})")
    return f"with {', '.join(out)} select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, f folded_root, f = root verified from w{depth + group_depth}"


MANIFEST_SQL = manifest_sql()
