"""Exact removal of long repeated byte strings by enhanced suffix arrays over content-chosen anchors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus. Every such string
holds an anchor that all its copies hold at the same place (see ``_winnow``), so suffixes need comparing only at anchors:

1. Each text's anchors are emitted with a hash of the anchor and one of its context, the bytes in which every string of
   ``LENGTH`` around the anchor lies. Equal contexts within a task are combined before anything is shuffled.
2. Anchors are dealt by hash and sorted. Occurrences with equal contexts are covered outright; where an anchor has
   different contexts, one of each is kept and its bytes are fetched from the text.
3. The contexts of an anchor, in the order of what follows it, are a suffix array. A stack scan of its common-prefix
   lengths gives the interval tree; within each interval the longest common extension to the left is found by the order
   of the reversed left sides. Intervals whose members differ on the left are maximal repeats; each occurrence is covered
   by the longest string it shares there if that has ``LENGTH`` bytes.
4. Anchors with more than ``CROWD`` different contexts aren't collected. A string that two of them share begins in the
   first or in the second half of the places it can begin at, and so holds more of the left or of the right side: each half
   is a smaller group with a longer common part. Halving ends at single places, where equal strings are counted by key.
5. The spans of each text are merged and cut out.

Edge cases: null texts count as empty, texts shorter than ``LENGTH`` stay whole; repeated rows (also with one id) are each
other's copies; ids may be null; matches never cross documents; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, bounded_batches, drop_staged, staged, text_chunks
from ._winnow import BASE, _mix, anchors, range_hashes

LENGTH, GRAM = 200, 48
SIDE = LENGTH - GRAM  # how far a string of LENGTH bytes can reach before its anchor
CROWD = 4_096
SCAN_BYTES = 1 << 20  # of text hashed at a time; the hashes take some 80 bytes a byte
RANGE = 1_000  # a range of places low..high is carried as low * RANGE + high
KEY = "doc_id long, sig long"


def _context_hashes(buf: np.ndarray, low: np.ndarray, high: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Hashes of buf[low:high] and of where the anchor lies in it."""
    h = range_hashes(buf, low, high)
    return _mix(h + (high - low).astype(np.uint64) * np.uint64(BASE >> 3) + where.astype(np.uint64) * np.uint64(BASE >> 7))


def _scan(batches):
    """Anchors of texts (h, c, key, pos, dup) and, where a task holds equal contexts, spans (h null)."""
    import pyarrow as pa

    for batch in batches:
        sigs, at = batch.column("sig").to_numpy(), 0
        for keys, buf, offsets in text_chunks(batch, limit=SCAN_BYTES):
            n = len(offsets) - 1
            sig = sigs[at : at + n]
            at += n
            pos, h = anchors(buf, offsets, LENGTH, GRAM)
            if not len(pos):
                continue
            text = np.searchsorted(offsets, pos, "right") - 1
            low, high = np.maximum(offsets[text], pos - SIDE), np.minimum(offsets[text + 1], pos + LENGTH)
            c = _context_hashes(buf, low, high, pos - low)
            order = np.lexsort((c, h))
            same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
            first = np.append(True, ~same)
            several = np.zeros(len(pos), bool)
            several[order] = np.append(False, same) | np.append(same, False)
            send = np.zeros(len(pos), bool)
            send[order[first]] = True  # one of each context goes on
            wide = offsets + np.arange(n + 1)  # a free place after each text keeps spans apart
            edge = np.zeros(len(buf) + n + 1, np.int32)
            np.add.at(edge, (low + text)[several], 1)
            np.add.at(edge, (high + text)[several], -1)
            change = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            owner = np.searchsorted(wide, starts, "right") - 1
            starts, ends = starts - owner, ends - owner
            ids = keys.cast(pa.int64())
            for which, a, b, hh, cc, dup in ((text[send], pos[send], high[send], h[send], c[send], several[send]), (owner, starts, ends, None, None, None)):
                if len(which):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "h": pa.nulls(len(which), pa.int64()) if hh is None else pa.array(hh.view(np.int64)),
                            "c": pa.nulls(len(which), pa.int64()) if cc is None else pa.array(cc.view(np.int64)),
                            "doc_id": ids.take(pa.array(which)),
                            "sig": pa.array(sig[which]),
                            "start": pa.array(a - offsets[which]),
                            "end": pa.array(b - offsets[which]),
                            "dup": pa.nulls(len(which), pa.bool_()) if dup is None else pa.array(dup),
                        }
                    )


def _sort_out(batches):
    """From anchors sorted by (h, c): spans of occurrences whose context occurs again, and one row for each context of an anchor that has several."""
    import pyarrow as pa

    def rows(t, index, need):
        t = t.take(pa.array(index))
        begin = t.column("start").to_numpy()
        if not need:
            begin = np.maximum(0, begin - SIDE)
        return pa.table({"h": t.column("h"), "doc_id": t.column("doc_id"), "sig": t.column("sig"), "start": begin, "end": t.column("end"), "need": [need] * len(begin)}).combine_chunks().to_batches()[0]

    held, had_twin = None, False  # the last row, and whether one before it has its context
    rep, had_other = None, False  # the last context's first row, and whether the anchor had a context before it
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        h, c, dup = t.column("h").to_numpy(), t.column("c").to_numpy(), t.column("dup").to_numpy()
        twin = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        before = np.append(had_twin, twin)
        cover = (before[:-1] | twin) & ~dup[:-1]
        if cover.any():
            yield rows(t, np.flatnonzero(cover), False)
        new = np.flatnonzero(~before)
        if held is not None and len(new) and new[0] == 0:
            new = new[1:]  # it is the held row, already the last context's first
        reps = t.take(pa.array(new))
        if rep is not None:
            reps = pa.concat_tables([rep, reps]).combine_chunks()
        rh = reps.column("h").to_numpy()
        if len(rh):
            with_next = rh[1:] == rh[:-1]
            need = np.append(had_other if rep is not None else False, with_next)[:-1] | with_next
            if need.any():
                yield rows(reps, np.flatnonzero(need), True)
            had_other = bool(with_next[-1]) if len(with_next) else had_other if rep is not None else False
            rep = reps.slice(len(rh) - 1)
        held, had_twin = t.slice(t.num_rows - 1), bool(before[-1])
    if held is not None:
        if had_twin and not held.column("dup")[0].as_py():
            yield rows(held.combine_chunks(), [0], False)
        if had_other:
            yield rows(rep.combine_chunks(), [0], True)


def _fetch(batches):
    """The bytes before and from each wanted anchor on."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("h", "doc_id", "sig", "pos", "left", "right")}
        size = 0
        for doc_id, sig, packed, wanted in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "sig", "packed", "wanted"))):
            text = unpack.decompress(packed)
            for w in wanted:
                p = w["start"]
                out["h"].append(w["h"])
                out["doc_id"].append(doc_id)
                out["sig"].append(sig)
                out["pos"].append(p)
                out["left"].append(text[max(0, p - SIDE) : p])
                out["right"].append(text[p : p + LENGTH])
                size += 1
            if size > 8_000:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("pos", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]))
                out, size = {k: [] for k in out}, 0
        if size:
            yield pa.RecordBatch.from_pydict(out, pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("pos", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]))


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), width), np.uint8)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def _common(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    limit = np.minimum(size[a], size[b])
    differ = m[a] != m[b]
    return np.minimum(np.where(differ.any(1), differ.argmax(1), m.shape[1]), limit)


def maximal_repeats(lefts: list[bytes], left: np.ndarray, lsize: np.ndarray, right: np.ndarray, rsize: np.ndarray, least: int = LENGTH):
    """Maximal repeats around one anchor, as (members, common length to the right, longest shared length to the left of each).

    Rows of ``right`` are in order: they are the suffix array. ``left`` holds the reversed left sides (``lefts``, as bytes).
    The stack scan closes the intervals of the common-prefix tree from the longest common length down. Each keeps its
    members in the order of their left sides; where two intervals meet, only members that get a new neighbour are looked
    at: if their left extensions agree for longer than with any member before, they form a new maximal repeat, reported
    if it has ``least`` bytes in all.
    """
    n = len(right)
    rows = np.arange(n)
    lcp = _common(right, rsize, rows[:-1], rows[1:]).tolist()
    by_left = np.array(sorted(range(n), key=lefts.__getitem__))
    rank = np.empty(n, np.int64)
    rank[by_left] = rows
    best = np.zeros(n, np.int64)
    found, stack = [], []  # of open intervals: common length, and the ranks of the members in order

    def meet(length: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        at = np.searchsorted(large, small)
        both = np.insert(large, at, small)
        place = at + np.arange(len(small))
        before, after = place[place > 0], place[place + 1 < len(both)]
        x, y = by_left[both[np.append(before - 1, after)]], by_left[both[np.append(before, after + 1)]]
        shared = _common(left, lsize, x, y)
        touched = np.unique(np.append(x, y))
        was = best[touched]
        np.maximum.at(best, x, shared)
        np.maximum.at(best, y, shared)
        grown = touched[(best[touched] > was) | ((was == 0) & (best[touched] == 0))]
        grown = grown[best[grown] + length >= least]
        if len(grown):
            found.append((grown, length, best[grown]))
        return both

    for i in range(1, n + 1):
        now, current = lcp[i - 1] if i < n else -1, rank[i - 1 : i]
        while stack and stack[-1][0] > now:
            length, members = stack.pop()
            current = meet(length, members, current)
        if stack and stack[-1][0] == now:
            stack[-1] = (now, meet(now, stack[-1][1], current))
        else:
            stack.append((now, current))
    return found


def _compare(batches, limit: int):
    """From contexts sorted by (h, right): spans of repeats; contexts of anchors with more than ``limit`` are handed on."""
    import pyarrow as pa

    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

    def spans(t, pos, low, high, index):
        if not len(index):
            return None
        t = t.take(pa.array(index))
        none, bare = pa.nulls(len(index), pa.int64()), pa.nulls(len(index), pa.binary())
        return pa.table([none, t.column("doc_id"), t.column("sig"), pa.array(pos[index] - low), pa.array(pos[index] + high), bare, bare], schema=schema).combine_chunks().to_batches()[0]

    def crowd(t):
        return pa.table([t.column(k) for k in ("h", "doc_id", "sig", "pos", "range", "left", "right")], schema=schema).combine_chunks().to_batches()[0]

    def work(t):
        """All anchors of a table that holds each of them whole."""
        h, pos = t.column("h").to_numpy(), t.column("pos").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        reversed_ = [x[::-1] for x in t.column("left").to_pylist()]
        lefts, lsize = _matrix(reversed_, SIDE)
        rights, rsize = _matrix(t.column("right").to_pylist(), LENGTH)
        size = np.diff(bounds)
        pair = bounds[:-1][size == 2]
        lcs, lcp = _common(lefts, lsize, pair, pair + 1), _common(rights, rsize, pair, pair + 1)
        ok = lcs + lcp >= LENGTH
        index, low, high = [np.concatenate([pair[ok], pair[ok] + 1])], [np.tile(lcs[ok], 2)], [np.tile(lcp[ok], 2)]
        for a, b in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist()):
            for members, length, best in maximal_repeats(reversed_[a:b], lefts[a:b], lsize[a:b], rights[a:b], rsize[a:b]):
                index.append(members + a)
                low.append(best)
                high.append(np.full(len(members), length))
        return spans(t, pos, np.concatenate(low), np.concatenate(high), np.concatenate(index))

    held, crowded = None, None  # rows of an anchor that may go on; the anchor that is known to be crowded
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        if not t.num_rows:
            continue
        h = t.column("h").to_numpy()
        if crowded is not None:
            n = int(np.argmax(h != crowded)) if (h != crowded).any() else len(h)
            if n:
                yield crowd(t.slice(0, n))
            t, h = t.slice(n), h[n:]
            if not len(h):
                held = None
                continue
            crowded = None
        last = len(h) - int(np.argmax(h[::-1] != h[-1])) if (h != h[-1]).any() else 0
        whole, held = t.slice(0, last).combine_chunks(), t.slice(last).combine_chunks()
        if whole.num_rows:
            wh = whole.column("h").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(wh[1:] != wh[:-1]) + 1])
            size = np.repeat(np.diff(np.append(starts, len(wh))), np.diff(np.append(starts, len(wh))))
            many = size > limit
            if many.any():
                yield crowd(whole.filter(pa.array(many)))
                whole = whole.filter(pa.array(~many)).combine_chunks()
            if whole.num_rows and (out := work(whole)) is not None:
                yield out
        if held.num_rows > limit:
            crowded = held.column("h")[0].as_py()
            yield crowd(held)
            held = None
    if held is not None and held.num_rows > 1 and (out := work(held)) is not None:
        yield out


def _cut(batches):
    """Merge spans and cut them out."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc_id, none, packed, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "none", "packed", "spans"))):
            text = unpack.decompress(packed)
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            for k, v in zip(out, (None if none else doc_id, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest)):
                out[k].append(v)
        out["doc_id"] = pa.array(out["doc_id"], pa.int64())
        out["kept"] = pa.array(out["kept"], pa.binary())
        yield pa.RecordBatch.from_pydict(out)


def _pack(batches):
    """Texts compressed one by one, for the shuffles; other columns are passed on."""
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        texts = pa.array([press.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), texts], names=[*others, "packed"])


def _keyed(documents: DataFrame, *more) -> DataFrame:
    """doc_id (the least long for null), sig (a hash of the text), more, text (empty for null)."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("sig"), *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def repeat_spans(documents: DataFrame) -> DataFrame:
    """doc_id, sig (a hash of the text), start, end: byte spans, overlapping ones among them, that repeated strings cover."""
    bounded_batches(documents.sparkSession)
    long = _keyed(documents).filter(F.octet_length("text") >= LENGTH)
    found = staged(long.mapInArrow(_scan, f"h long, c long, {KEY}, start long, end long, dup boolean"), "anchors")
    by_anchor = found.filter("h is not null").repartition("h").sortWithinPartitions("h", "c")
    sorted_out = staged(by_anchor.mapInArrow(_sort_out, f"h long, {KEY}, start long, end long, need boolean"), "anchors-sorted")

    wanted = sorted_out.filter("need").groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "h")).alias("wanted"))
    packed = long.mapInArrow(_pack, f"{KEY}, packed binary")
    contexts = packed.join(wanted, ["doc_id", "sig"]).mapInArrow(_fetch, f"h long, {KEY}, pos long, left binary, right binary")
    compared = staged(_compared(contexts.withColumn("range", F.lit(SIDE).cast("long"))), "repeats")
    parts, todo = [compared.filter("h is null")], compared.filter("h is not null")
    while todo.limit(1).count():
        halves = staged(_halved(todo), "halves")
        low, high = F.floor(F.col("range") / RANGE), F.col("range") % RANGE
        single = halves.filter(low == high).withColumn("low", low)
        string = [F.substring("left", F.octet_length("left") - F.col("low") + 1, F.col("low")), F.substring("right", F.lit(1), LENGTH - F.col("low"))]
        keyed = single.select("h", F.xxhash64(F.lit(3), *string).alias("x"), "doc_id", "sig", (F.col("pos") - F.col("low")).alias("start"))
        again = keyed.groupBy("h", "x").agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(keyed.join(again, ["h", "x"], "left_semi").select("doc_id", "sig", "start", (F.col("start") + LENGTH).alias("end")))
        compared = staged(_compared(halves.filter(low < high)), "repeats")
        parts.append(compared.filter("h is null"))
        todo = compared.filter("h is not null")
    parts += [found.filter("h is null"), sorted_out.filter("not need")]
    spans = parts[0].select("doc_id", "sig", "start", "end")
    for p in parts[1:]:
        spans = spans.union(p.select("doc_id", "sig", "start", "end"))
    out = staged(spans, "spans")
    for used in (found, sorted_out):
        drop_staged(out.sparkSession, used)
    return out


def _compared(contexts: DataFrame) -> DataFrame:
    """Spans of the repeats among contexts (h, key, pos, range, left, right), and contexts of groups that are too large (h not null)."""
    return contexts.repartition("h").sortWithinPartitions("h", "right").mapInArrow(partial(_compare, limit=CROWD), f"h long, {KEY}, start long, end long, left binary, right binary")


def _halved(crowd: DataFrame) -> DataFrame:
    """Contexts of crowded groups, dealt anew for either half of the places at which a shared string can begin before the anchor."""
    low, high = F.floor(F.col("end") / RANGE).cast("int"), (F.col("end") % RANGE).cast("int")
    middle = F.floor((low + high) / 2).cast("int")
    halves = F.array(F.struct((middle + 1).alias("low"), high.alias("high")), F.struct(low.alias("low"), middle.alias("high")))
    rows = crowd.withColumn("half", F.explode(halves)).select("h", "doc_id", "sig", F.col("start").alias("pos"), "left", "right", "half.*")
    rows = rows.filter((F.octet_length("left") >= F.col("low")) & (F.octet_length("right") >= LENGTH - F.col("high")))
    common = [F.substring("left", F.octet_length("left") - F.col("low") + 1, F.col("low")), F.substring("right", F.lit(1), LENGTH - F.col("high"))]
    return rows.select(F.xxhash64("h", "low", "high", *common).alias("h"), "doc_id", "sig", "pos", (F.col("low") * RANGE + F.col("high")).cast("long").alias("range"), "left", "right")


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the kept bytes."""
    spark = documents.sparkSession
    spans = repeat_spans(documents)
    bounded_batches(spark)
    own = F.col("doc_id").isNull().alias("none")
    packed = _keyed(documents, own).mapInArrow(_pack, f"{KEY}, none boolean, packed binary")
    runs = spans.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = packed.join(runs, ["doc_id", "sig"], "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
