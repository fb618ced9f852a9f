"""Each operator against a brute-force version, an exact round trip or held-out labels, on small whole inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from credsift.llm import _pretoken, bpe, decontam, html_main, langid, line_dedup, quality, repeats, shard_pack, simhash, token_store
from credsift.llm._bpe_core import merge, pieces_of
from credsift.llm.queries import END_ID, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_shards_balance_and_number_without_gaps(docs):
    rows = shard_pack.assign_shards(docs).collect()
    shards = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and set(shards) <= set(range(24)) and {r.law for r in rows} == {"bytes"}
    for s, n in shards.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    groups = {}
    for r in rows:
        groups.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_packing_is_near_equal_and_joint():
    rng = np.random.default_rng(0)
    items = np.stack([rng.lognormal(7, 1.2, 6000), rng.lognormal(5, 1, 6000), rng.integers(1, 5, 6000)], 1)
    where = shard_pack.pack(items, 24)
    for k, most in ((0, 1.01), (1, 1.2), (2, 1.2)):
        load = np.bincount(where, items[:, k], 24)
        assert load.max() / load.mean() < most


def test_language_on_held_out_rows(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_windows_cover_every_ngram():
    buf = np.frombuffer(bytes(range(1, 255)) * 9, np.uint8)
    x, owner = langid.windows(buf, np.array([0, 1000, 1000, len(buf)]))
    for text, (a, b) in ((0, (0, 1000)), (2, (1000, len(buf)))):
        grams = {bytes(buf[i : i + 4]) for i in range(a, b - 3)}
        assert grams <= {bytes(w[i : i + 4]) for w in x[owner == text] for i in range(253)}


def test_pieces_match_the_library(library):
    rnd = random.Random(4)
    letters = list("abst're'vl md'  \n\t\r  09.,!-éßñ²Ⅷ中  　😀́_\x1c\x85​")
    for _ in range(400):
        some = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(14))) for _ in range(4)]
        raw = [t.encode() for t in some]
        got, _ = pieces_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        assert got == [t[a:b].encode() for t in some for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]
    assert _pretoken._classes()[ord("a")] == _pretoken.LETTER


def test_token_store_round_trip(spark, docs, texts, library):
    path = token_store.write_store(docs, tokenizer_path(), END_ID, block_ids=20_000)
    rows = {r.doc_id: r for r in token_store.read_store(spark, path).collect()}
    start = 0
    for i in sorted(texts):
        ids = library.encode(texts[i], add_special_tokens=False).ids + [END_ID]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_elias_fano_select():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (1000, 10**9), (777, 2**40)):
        values = np.sort(rng.integers(0, top, n))
        ef, used = token_store.EliasFano.read(memoryview(token_store.EliasFano.of(values).to_bytes()))
        assert ef.all().tolist() == values.tolist() and [ef.select(i) for i in range(n)] == values.tolist()
    dense = token_store.EliasFano.of(np.arange(0, 10**6, 100))
    assert len(dense.to_bytes()) < 10**4 * 8 / 5


def test_block_reads_one_document():
    ids, bounds = np.arange(50), np.array([0, 3, 3, 50])
    block = token_store.Block(token_store.pack_block([None, -4, 9], bounds, ids, 2))
    assert block.doc_ids == [None, -4, 9] and block.document(2).tolist() == list(range(3, 50)) and len(block.document(1)) == 0
    with pytest.raises(ValueError):
        token_store.Block(token_store.pack_block([1], np.array([0, 2]), ids[:2], 2)[:-1] + b"\x07")


def test_bpe_equals_the_library(docs, texts, library):
    extra = docs.sparkSession.createDataFrame([(-1, "a<|endoftext|>b " + "z" * 300), (-2, "  \n\n x'll")], "doc_id long, text string")
    every = texts | {-1: "a<|endoftext|>b " + "z" * 300, -2: "  \n\n x'll"}
    for r in bpe.encode_decode(docs.select("doc_id", "text").union(extra), tokenizer_path(), with_ids=True, with_text=True, lexicon_words=500).collect():
        ids = library.encode(every[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids)) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_lexicon_is_minimal_and_exact():
    words = [w.encode() for w in "tap taps top tops stop stops at ats é és".split()]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, tokenizer_path()))
    assert sorted(lexicon.find(words).tolist()) == list(range(len(words))) and lexicon.find([b"ta", b"tapss", b"", b"zz"]).tolist() == [-1] * 4
    assert lexicon.resolver(tokenizer_path())([b"tops", b"nowhere"]) == [merge(b"tops", tokenizer_path()), merge(b"nowhere", tokenizer_path())]
    assert len(lexicon.final) < len(set(w[:k] for w in words for k in range(len(w) + 1)))  # fewer states than a trie


def brute_components(fps, bits=3):
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum((2 * c > len(shingles)) << b for b, c in enumerate(count))


@pytest.mark.parametrize("crowd, block", [(64, 2048), (2, 3)])
def test_simhash_components(spark, docs, texts, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = " ".join(f"w{i}" for i in range(300))
    near = {10_000 + i: base.replace(f"w{7 * i} ", "changed ", 1) for i in range(25)}
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(near.items()), "doc_id long, text string"))
    fps = {i: brute_fingerprint(t) for i, t in (texts | near).items()}
    want = brute_components(fps)
    for r in simhash.near_duplicates(both).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_against_all_pairs(spark, edits):
    rnd = random.Random(edits)
    bases, rows = [f"{rnd.getrandbits(128):032x}" for _ in range(5)], []
    for i in range(40):
        x = list(rnd.choice(bases))
        for _ in range(rnd.randrange(3)):
            p, o = rnd.randrange(len(x)), rnd.randrange(3)
            x[p : p + (o < 2)] = rnd.choice("xyzé") if o != 1 else ""
        rows.append((i, "".join(x) + "\nshort\n" + f"own line number {i} of text"))
    lines = [(i, k, line) for i, t in rows for k, line in enumerate(t.split("\n"))]
    first = {}
    for i, k, line in lines:
        first.setdefault(line, (i, k))
    want = {i: [0, 0] for i, _ in rows}
    for i, k, line in lines:
        if len(line) >= 16 and any(len(m) >= 16 and first[m] < first[line] and m != line and levenshtein(m, line) <= edits for m in first):
            want[i][1] += 1
        elif first[line] != (i, k):
            want[i][0] += 1
    want = {i: [0, 0] if sum(w) == 3 else w for i, w in want.items()}  # copies are left whole
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string"), ((16, edits),)).collect()
    assert {r.doc_id: [r.n_equal, r.n_near] for r in got} == want


def test_line_dedup_keeps_columns(spark):
    d = spark.createDataFrame([(1, "The licence line of all files.\nfirst own words", 5), (2, "The licence line of all files.\nsecond own words", 5)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, line_dedup.dedup_lines(d).collect())) == [(1, "The licence line of all files.\nfirst own words", 5), (2, "second own words", 16)]


def test_leaks_with_edits():
    rnd = random.Random(3)
    items = [" ".join(f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(15, 50))) for _ in range(40)]
    known, hit, total = decontam.Items(list(range(40)), [t.encode() for t in items]), 0, 0
    for _ in range(120):
        j = rnd.randrange(40)
        words = items[j].split()
        for _ in range(rnd.randrange(0, int(0.2 * len(words)) + 1)):
            p, o = rnd.randrange(len(words)), rnd.randrange(3)
            words[p : p + (o < 2)] = ["new"] if o != 1 else []
        host = [f"h{rnd.randrange(900)}" for _ in range(60)]
        text = " ".join([*host[:30], *words, *host[30:]]).encode()
        w, first = decontam.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        best, _ = decontam.edits_within(known.words[j], w)
        if best <= known.limit[len(known.words[j])]:
            total += 1
            hit += any(g[1] == j and g[2] == best for g in known.find(w, first))
    assert total > 80 and hit >= 0.98 * total
    clean = " ".join(f"h{rnd.randrange(900)}" for _ in range(5000)).encode()
    assert known.find(*decontam.words_of(np.frombuffer(clean, np.uint8), np.array([0, len(clean)]))) == []


def test_edit_distance_with_free_ends():
    a = lambda s: np.array([ord(c) for c in s], np.uint64)
    for item, text in (("abcde", "xxabcdeyy"), ("abcde", "xxabdeyy"), ("abc", ""), ("abc", "xyz"), ("abcd", "axbxcxd"), ("abab", "bbbaabba")):
        want = min(levenshtein(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontam.edits_within(a(item), a(text))[0] == want


def test_planted_leaks_are_found_and_removed(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {i for i, t in texts.items() if any(x in t for x in items.values())}
    found = {r.doc_id for r in decontam.find_leaks(docs, bench).collect()}
    assert want <= found
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == set(texts) - found


def test_main_text_by_structure():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body class='no-sidebar'><header>Site</header><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><header><h1>A  title</h1></header><p>One &amp; <b>two</b>\n three<br>four<p>Five<script>x='</p>'</script><aside>Side</aside><form><input>Send</form><ul><li>a<li>b</ul>"
        "<section id=comments><p>Nice!</p></section></article><div class=sidebar>More</div><footer>&copy; us</footer></body></html>"
    )
    kept = [t for t, k in html_main.blocks_of(page) if k == html_main.TEXT]
    assert kept == ["A title", "One & two three four", "Five", "a", "b"]


def test_host_suffix_array_decides_unmarked_pages(spark):
    menu, foot = "Home News Sports Weather Contact About Terms Privacy Imprint", "Copyright by the host of these pages and all of its friends"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{menu}</div><div>unique words number {i} and {i * 7} more things here</div><div>{foot}</div></body>") for i in range(5)]
    rows.append((9, "http://other.example/", f"<div>{menu}</div>"))
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"unique words number {i} and {i * 7} more things here" for i in range(5)} | {9: menu}


def test_suffix_runs():
    tokens, page = np.array([1, 2, 3, 9, 1, 2, 3, 1, 2]), np.array([0, 0, 0, 0, 1, 1, 1, 1, 1])
    order, kind = html_main.suffix_runs(tokens, page, 3)
    same = {}
    for p, k in zip(order.tolist(), kind.tolist()):
        same.setdefault(k, []).append(p)
    assert sorted(same.values()) == [[0, 4], [1], [5], [6]]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, docs, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.assess(docs).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == {r.doc_id for r in rows if r.kept}


def test_em_parts_good_from_bad():
    rnd, votes = random.Random(0), Counter()
    for _ in range(4000):
        good = rnd.random() < 0.8
        fires = lambda on_bad, on_good: -1 if rnd.random() < (on_good if good else on_bad) else 0
        usual = 1 if rnd.random() < (0.95 if good else 0.3) else 0
        votes[(fires(0.9, 0.01), fires(0.8, 0.01), fires(0.5, 0.3), usual)] += 1
    prior, weights = quality.fit(list(votes.items()))
    odds = lambda *v: prior + sum(w[x] for w, x in zip(weights, v))
    assert odds(-1, -1, 0, 0) < 0 < odds(0, 0, 0, 1) and odds(-1, -1, -1, 0) < 0


def brute_repeats(texts, length=200):
    count = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        mark = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[k] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_all_windows(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(70)) for _ in range(3)]
    rows = {}
    for i in range(40):
        parts = [" ".join(word() for _ in range(rnd.randrange(5, 60)))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passage)
            a = rnd.randrange(60)
            parts += [p[a : len(p) - rnd.randrange(60)], word()]
        rows[i] = " ".join(parts)
    rows |= {50: "ab" * 400, 51: "Heat " * 90, 52: "x" * 199, 53: "x" * 200, 54: rows[0], 55: ""}
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(d).collect()}
    assert got == brute_repeats({k: t.encode() for k, t in rows.items()})


