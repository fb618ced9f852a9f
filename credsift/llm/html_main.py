"""Main text of web pages: marked structure first, and a suffix array of each host for what no markup decides.

A page is read into blocks. Blocks within menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
the like (by element, role or class) are boilerplate; blocks of an ``article`` (else of the main region) are text. A wrapper
whose longer name holds such a word (``has-sidebar``) doesn't drop an article within it. Where a
page marks neither, its blocks are undecided, and its host decides: the token streams of the host's pages, boilerplate and
undecided, are laid end to end, their suffixes sorted, and runs of ``RUN`` tokens or more that occur on different pages
are boilerplate; unique runs are kept.

Marked articles take part too: a block of ``RUN`` tokens or more within one is a notice of the host, not of the article, if all its
runs stand in at least half of the host's different articles (``LEAST_ARTICLES`` at least; articles with the same longest block
are one). Copies of articles are spared: where such blocks hold more than a quarter of an article's tokens, all stay.
Shorter blocks stay. A block can only be such a notice if its first run is that frequent, so only these blocks meet in suffix arrays.

Suffix arrays are built over the pages of a host that one task holds, which yields one representative of each run; runs
that only repeat between tasks are found by an aggregation over these. A host of any size is dealt over many tasks.

Edge cases: null or empty html gives an empty text; truncated tags and unclosed elements are tolerated; null urls share one
host; repeated rows of one page aren't different pages; a page's text may be empty; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, staged
from ._winnow import _mix

RUN = 8
LEAST_ARTICLES, HOST_SHARE, COPY_SHARE = 5, (1, 2), (1, 4)
DEAL_PAGES = 500  # pages of one host that one task holds, about
TEXT, BOILERPLATE, UNDECIDED = 0, 1, 2

# Fixed vocabularies of HTML and of common class names.
RAW = frozenset("script style noscript template iframe textarea svg canvas object title math".split())
DROP = frozenset("nav header footer aside form button select menu dialog head".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations sidebar widget nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead toolbar pagination pager copyright".split())
#: Those that also name a layout around an article (``has-sidebar``) or stand in prose' own classes (``share price``).
LOOSE = frozenset("share sharing social sidebar nav navbar navigation menu menubar footer header masthead toolbar widget notice notices banner modal overlay login signup subscribe subscription".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|/?[a-zA-Z][^>]*+(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _traits(name: str, rest: str, in_article: bool) -> tuple[int, bool]:
    """Whether an element is boilerplate (2; 1 if only loose words in a longer name say so), and whether it is a main region."""
    found = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
    tokens = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    role = found.get("role", "").lower()
    if name in ("html", "body"):
        return 0, False
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if name in ("article", "main") or role in ("main", "article"):
        return 2 * (hidden or bool(tokens & {"comment", "comments", "ad", "ads", "advert", "sponsored", "related", "promo"})), True
    main = bool(tokens & MAIN_WORDS) and name in ("div", "section", "td")
    words = tokens & WORDS | ({"header"} & tokens if not in_article else set())
    if hidden or role in ROLES or words - LOOSE or (name in DROP and not (name == "header" and in_article)):
        return 2, main
    if not words or in_article and name in PROSE and tokens - WORDS:
        return 0, main
    return (1 if tokens - WORDS - {"header"} else 2), main


def blocks_of(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with its kind."""
    out: list[list] = []  # text, boilerplate (1: by loose words), in an article or main element (1: in a wrapper of such words), in a region named like one
    stack: list[tuple[str, int, int, bool]] = []  # element, and the three flags within it
    piece: list[str] = []
    flags = (0, 0, False)
    at, end = 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            out.append([text, *flags])
        piece.clear()

    def leave(name: str) -> None:
        nonlocal flags
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                before = flags
                del stack[i:]
                new = stack[-1][1:] if stack else (0, 0, False)
                if new != before:
                    flush()
                flags = new
                return

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            piece.append(page[at:])
            break
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            leave(name)
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in CLOSES_P and stack and any(s[0] == "p" for s in stack[-3:]):
            leave("p")
        if name in ("li", "dt", "dd", "tr", "option") and stack and stack[-1][0] == name:
            leave(name)
        if name in ("td", "th"):
            piece.append(" ")
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        drop, main = _traits(name, m[3], bool(flags[1]))
        article = main and (name in ("article", "main") or "role" in m[3])
        if article and not drop and flags[0] == 1:  # a wrapper's name doesn't drop an article, but one outside such a wrapper comes first
            new = (0, flags[1] or 1, True)
        else:
            new = (max(flags[0], drop), flags[1] or 2 * article, flags[2] or main)
        if new != flags:
            flush()
        stack.append((name, *new))
        flags = new
    flush()
    first = max((b[2] for b in out if not b[1]), default=0)
    level = 1 if first else 2 if any(b[3] and not b[1] for b in out) else 0
    inside = {0: lambda b: True, 1: lambda b: b[2] >= first, 2: lambda b: b[3]}[level]
    return [(b[0], BOILERPLATE if b[1] or not inside(b) else TEXT if level else UNDECIDED) for b in out]


def suffix_runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array to the depth of ``run`` tokens: positions in order, and the class of each (equal for equal prefixes).

    ``tokens`` are numbers; the suffixes end with their page. Ranks are doubled in length until they cover ``run`` tokens.
    """
    n = len(tokens)
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    last = np.append(np.flatnonzero(page[1:] != page[:-1]), n - 1)
    end = last[np.searchsorted(last, np.arange(n))]
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.zeros(n, np.int64)
        ok = np.arange(n) + step <= end
        ahead[ok] = rank[np.flatnonzero(ok) + step]
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    whole = np.flatnonzero(np.arange(n) + run - 1 <= end)
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, rank[order]


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64)


def _run_hashes(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``RUN`` tokens from each place on."""
    x, y = np.zeros(len(at), np.uint64), np.full(len(at), 7, np.uint64)
    for k in range(RUN):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + token[at + k])
        y = _mix((y ^ token[at + k]) * np.uint64(0xD6E8FEB86659FD93))
    return x.view(np.int64), y.view(np.int64)


def _heads(blocks: list[str]) -> list[dict]:
    """Hashes of the first run of each block that is long enough."""
    first = [w for b in blocks if len(own := b.split(" ", RUN)[:RUN]) == RUN for w in own]
    if not first:
        return []
    x, y = _run_hashes(_hashes(first), np.arange(0, len(first), RUN))
    return [{"x": a, "y": b} for a, b in zip(x.tolist(), y.tolist())]


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        rows = {"page_id": batch.column("page_id"), "url": batch.column("url"), "decided": [], "text": [], "blocks": [], "kinds": [], "article": [], "heads": []}
        for page in batch.column("html").to_pylist():
            found = blocks_of(page or "")
            decided = not any(k == UNDECIDED for _, k in found)
            rows["decided"].append(decided)
            texts = [t for t, k in found if k == TEXT] if decided else []
            rows["text"].append("\n\n".join(texts) if decided else None)
            rows["article"].append(max(texts, key=len, default=""))
            rows["heads"].append(_heads(texts))
            rest = [(t, k) for t, k in found if k != TEXT]
            rows["blocks"].append([t for t, _ in rest])
            rows["kinds"].append([k for _, k in rest])
        rows["article"] = pa.array(_hashes(rows["article"]).view(np.int64))
        rows["heads"] = pa.array(rows["heads"], pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))
        rows["kinds"] = pa.array(rows["kinds"], pa.list_(pa.int32()))
        rows["blocks"] = pa.array(rows["blocks"], pa.list_(pa.string()))
        rows["text"] = pa.array(rows["text"], pa.string())
        yield pa.RecordBatch.from_pydict(rows)


def _runs(batches):
    """For each host's pages in a batch: one row of each run of tokens (hashes x, y), or of each place where it isn't known to repeat yet."""
    import pyarrow as pa

    for batch in batches:
        hosts = batch.column("host").to_numpy()
        ids = batch.column("page").to_numpy()
        streams = [[w for b in blocks for w in b.split()] for blocks in batch.column("blocks").to_pylist()]
        for host in np.unique(hosts):
            own = [i for i in np.flatnonzero(hosts == host).tolist() if streams[i]]
            words = [w for i in own for w in streams[i]]
            if len(words) < RUN:
                continue
            size = np.array([len(streams[i]) for i in own])
            page = np.repeat(np.arange(len(own)), size)
            place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
            token = _hashes(words)
            order, kind = suffix_runs(token, page)
            if not len(order):
                continue
            x, y = _run_hashes(token, order)
            start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(kind))))
            key = ids[np.array(own)][page[order]]
            least, most = np.minimum.reduceat(key, start), np.maximum.reduceat(key, start)
            twice = (least != most)[number]
            first = np.zeros(len(order), bool)
            first[start] = True
            send = ~twice | first
            yield pa.RecordBatch.from_pydict({"host": pa.array([host] * int(send.sum()), pa.int64()), "x": pa.array(x[send]), "y": pa.array(y[send]), "least": pa.array(least[number][send]), "most": pa.array(most[number][send])})


def _keep_unique(batches):
    """Cut from undecided blocks what the host's repeated runs cover."""
    import pyarrow as pa

    for batch in batches:
        text = []
        for blocks, kinds, repeated in zip(*(batch.column(k).to_pylist() for k in ("blocks", "kinds", "repeated"))):
            known = {(r["x"], r["y"]) for r in repeated or ()}
            words = [w for b in blocks for w in b.split()]
            covered = np.zeros(len(words) + 1, np.int64)
            if known and len(words) >= RUN:
                x, y = _run_hashes(_hashes(words), np.arange(len(words) - RUN + 1))
                for i, pair in enumerate(zip(x.tolist(), y.tolist())):
                    if pair in known:
                        covered[i : i + RUN] = 1
            kept, at = [], 0
            for b, kind in zip(blocks, kinds):
                own = b.split()
                mark = covered[at : at + len(own)]
                at += len(own)
                if not mark.all():  # a run that only reaches into a block doesn't cut it
                    edge = np.flatnonzero(np.diff(mark, prepend=0, append=0)).reshape(-1, 2)
                    for low, high in edge[edge[:, 1] - edge[:, 0] < RUN]:
                        mark[low:high] = 0
                left = " ".join(w for w, c in zip(own, mark.tolist()) if not c)
                if kind == UNDECIDED and left:
                    kept.append(left)
            text.append("\n\n".join(kept))
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string())})


def _candidates(batches):
    """Blocks of marked articles whose first run is frequent on the host, a row for each."""
    import pyarrow as pa

    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("host", "row", "article", "blocks")}
        for host, row, article, text, wide in zip(*(batch.column(k).to_pylist() for k in ("host", "row", "article", "text", "wide"))):
            known = {(w["x"], w["y"]) for w in wide}
            for b in text.split("\n\n"):
                if (h := _heads([b])) and (h[0]["x"], h[0]["y"]) in known:
                    for k, v in zip(out, (host, row, article, [b])):
                        out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def _article_runs(batches):
    """The runs of candidate blocks by a suffix array over those of a batch: each once for a host's article."""
    import pyarrow as pa

    for batch in batches:
        streams = [blocks[0].split() for blocks in batch.column("blocks").to_pylist()]
        words = [w for s in streams for w in s]
        if not words:
            continue
        block = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        token = _hashes(words)
        order, kind = suffix_runs(token, block)
        rows = np.stack([kind, batch.column("host").to_numpy()[block[order]], batch.column("article").to_numpy()[block[order]]], 1)
        rows, at = np.unique(rows, axis=0, return_index=True)
        x, y = _run_hashes(token, order[at])
        yield pa.RecordBatch.from_pydict({"host": pa.array(rows[:, 1].copy()), "article": pa.array(rows[:, 2].copy()), "x": pa.array(x), "y": pa.array(y)})


def _without_notices(batches):
    """Articles without the blocks all of whose runs are frequent on the host; copies of articles stay whole."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for text, repeated in zip(*(batch.column(k).to_pylist() for k in ("text", "repeated"))):
            known = {(r["x"], r["y"]) for r in repeated or ()}
            kept, size, gone = [], 0, 0
            for b in text.split("\n\n") if known else ():
                own = b.split()
                size += len(own)
                wide = len(own) >= RUN
                if wide:
                    x, y = _run_hashes(_hashes(own), np.arange(len(own) - RUN + 1))
                    wide = all(p in known for p in zip(x.tolist(), y.tolist()))
                if wide:
                    gone += len(own)
                else:
                    kept.append(b)
            out.append("\n\n".join(kept) if gone and COPY_SHARE[1] * gone <= COPY_SHARE[0] * size else text)
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string())})


def _decided(marked: DataFrame) -> DataFrame:
    """page_id, url, text of pages whose article is marked, without the notices of their host."""
    plain = marked.select("page_id", "url", "text")
    articles = marked.groupBy("host").agg(F.countDistinct("article").alias("articles")).filter(F.col("articles") >= LEAST_ARTICLES)

    def frequent(runs: DataFrame) -> DataFrame:
        n = runs.select("host", "article", "x", "y").distinct().groupBy("host", "x", "y").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ARTICLES)
        return n.join(articles, "host").filter(HOST_SHARE[1] * F.col("n") >= HOST_SHARE[0] * F.col("articles")).select("host", "x", "y")

    heads = staged(frequent(marked.select("host", "article", F.inline("heads"))), "heads")
    if not heads.limit(1).count():
        return plain
    rows = marked.withColumn("row", F.xxhash64("page_id", "url", "text"))
    some = lambda found, name: found.groupBy("row").agg(F.collect_set(F.struct("x", "y")).alias(name))
    wide = some(rows.select("host", "row", F.inline("heads")).join(heads, ["host", "x", "y"], "left_semi"), "wide")
    blocks = staged(rows.join(wide, "row").select("host", "row", "article", "text", "wide").mapInArrow(_candidates, "host long, row long, article long, blocks array<string>"), "candidates")
    runs = staged(frequent(blocks.mapInArrow(_article_runs, "host long, article long, x long, y long")), "host-runs")
    held = blocks.select("host", "row", "blocks").mapInArrow(_held, "host long, row long, x long, y long")
    hits = some(held.join(runs, ["host", "x", "y"], "left_semi"), "repeated")
    return rows.join(hits, "row", "left").select("page_id", "url", "text", "repeated").mapInArrow(_without_notices, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = pages.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[^:/?#]+:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    read = staged(source.mapInArrow(_read, "page_id long, url string, decided boolean, text string, blocks array<string>, kinds array<int>, article long, heads array<struct<x: long, y: long>>"), "pages")
    streams = read.withColumn("host", host).withColumn("page", F.coalesce("page_id", F.lit(-1)))
    salts = max(64, read.count() // DEAL_PAGES)
    dealt = streams.select("host", "page", "blocks").repartition("host", F.pmod(F.xxhash64("page"), F.lit(salts)))
    runs = dealt.mapInArrow(_runs, "host long, x long, y long, least long, most long")
    repeated = runs.groupBy("host", "x", "y").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least <> most").select("host", "x", "y")

    # Undecided pages look up the runs they hold.
    undecided = streams.filter("not decided")
    asks = undecided.select("page_id", "url", "blocks", "kinds", "host", F.xxhash64("page_id", "url", "blocks").alias("row"))
    held = asks.select("host", "row", "blocks").mapInArrow(_held, "host long, row long, x long, y long")
    hits = held.join(repeated, ["host", "x", "y"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("x", "y")).alias("repeated"))
    rest = asks.join(hits, "row", "left").select("page_id", "url", "blocks", "kinds", "repeated").mapInArrow(_keep_unique, "page_id long, url string, text string")
    out = _decided(streams.filter("decided")).union(rest)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def _held(batches):
    """The runs that a page holds."""
    import pyarrow as pa

    for batch in batches:
        for host, row, blocks in zip(*(batch.column(k).to_pylist() for k in ("host", "row", "blocks"))):
            words = [w for b in blocks for w in b.split()]
            n = len(words) - RUN + 1
            if n < 1:
                continue
            x, y = _run_hashes(_hashes(words), np.arange(n))
            yield pa.RecordBatch.from_pydict({"host": pa.array([host] * n, pa.int64()), "row": pa.array([row] * n, pa.int64()), "x": pa.array(x), "y": pa.array(y)})
