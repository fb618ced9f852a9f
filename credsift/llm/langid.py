"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 run over windows of 256 bytes, each filter's largest response is kept
and a softmax gives the languages' probabilities; a text's are the means over all its windows. Windows overlap by three
bytes, so no n-gram of a text is missed. For prediction the filters are unfolded into tables over byte pairs.

Training reads at most about ``SAMPLE_DOCS`` labelled texts of each language (the lowest hashes of the id) and
``SAMPLE_WINDOWS`` windows of each; this bound is the documented parameter. Held-out rows, sources and ids are not used.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every text is ``und``;
with one language its score is 1; ties go to the first language in order; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, text_chunks

LENGTH, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
OVERLAP = max(WIDTHS) - 1
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, BATCH = 400, 4, 6, 64
STEPS = 400  # of training at least, so that few windows are gone over more often


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (rows of 256 bytes, zero after a text's end) and the text of each. Empty texts have none."""
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // (LENGTH - OVERLAP))), 0)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (offsets[:-1][owner] + nth * (LENGTH - OVERLAP))[:, None] + np.arange(LENGTH)
    inside = at < offsets[1:][owner][:, None]
    padded = buf if len(buf) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8), owner


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7) -> dict:
    """Weights learned from windows ``x`` and their classes, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.5, (256, EMBED)), "V": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for low in range(0, len(x), BATCH):
            rows = order[low : low + BATCH]
            xb, yb, n = x[rows], y[rows], len(rows)
            e = p["E"][xb]
            pooled, peak = [], {}
            for w in WIDTHS:
                r = sum(e[:, k : LENGTH - w + 1 + k] @ p[f"W{w}"][k] for k in range(w)) + p[f"b{w}"]
                peak[w] = r.argmax(1)
                pooled.append(np.take_along_axis(r, peak[w][:, None], 1)[:, 0])
            z = np.concatenate(pooled, 1)
            a = np.maximum(z, 0)
            logit = a @ p["V"] + p["c"]
            q = np.exp(logit - logit.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), yb] -= 1
            q /= n
            g = {"V": a.T @ q, "c": q.sum(0), "E": np.zeros_like(p["E"])}
            dz = (q @ p["V"].T) * (z > 0)
            for j, w in enumerate(WIDTHS):
                d = dz[:, j * FILTERS : (j + 1) * FILTERS]
                g[f"b{w}"] = d.sum(0)
                g[f"W{w}"] = np.zeros_like(p[f"W{w}"])
                for k in range(w):
                    byte = np.take_along_axis(xb, peak[w] + k, 1)
                    g[f"W{w}"][k] = np.einsum("nfe,nf->ef", p["E"][byte], d)
                    np.add.at(g["E"], byte, d[:, :, None] * p[f"W{w}"][k].T[None])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= (0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


class Network:
    """The trained network with its filters unfolded into tables over pairs of bytes."""

    def __init__(self, p: dict):
        self.p = p
        e = p["E"]
        pair = lambda w, i, j: ((e @ p[f"W{w}"][i])[:, None] + (e @ p[f"W{w}"][j])[None]).reshape(65536, FILTERS)
        self.two = np.concatenate([pair(2, 0, 1), pair(3, 0, 1), pair(4, 0, 1)], 1)  # by the pair at a position
        self.third, self.last = e @ p["W3"][2], pair(4, 2, 3)
        self.bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])

    def probabilities(self, x: np.ndarray, step: int = 96) -> np.ndarray:
        out = np.zeros((len(x), len(self.p["c"])), np.float32)
        f = FILTERS
        for low in range(0, len(x), step):
            b = x[low : low + step]
            n = len(b)
            pair = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            r = np.take(self.two, pair, axis=0)
            r[:, : LENGTH - 2, f : 2 * f] += np.take(self.third, b[:, 2:], axis=0)
            r[:, : LENGTH - 3, 2 * f :] += np.take(self.last, pair[:, 2:], axis=0)
            r[:, LENGTH - 2 :, f : 2 * f] = -np.inf  # a filter must lie within the window
            r[:, LENGTH - 3 :, 2 * f :] = -np.inf
            z = r.max(1) + self.bias
            logit = np.maximum(z, 0) @ self.p["V"] + self.p["c"]
            q = np.exp(logit - logit.max(1, keepdims=True))
            out[low : low + n] = q / q.sum(1, keepdims=True)
        return out


def fit(documents: DataFrame, docs: int = SAMPLE_DOCS) -> tuple[list[str], dict | None]:
    """The languages in order and the network's weights (None without labelled text)."""
    spark = documents.sparkSession
    labelled = documents.filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return [], None
    # Hashes of the id below a threshold that lets about ``docs`` rows of each language through.
    share = F.element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs / r["n"])))), F.col("lang"))
    key = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40))
    bounded_batches(spark)
    chosen = labelled.select("lang", F.col("text").cast("string").alias("text"), key.alias("key")).filter(F.col("key") < share * (1 << 40))
    rows = chosen.mapInArrow(_some_windows, "lang string, key long, x binary").orderBy("key", "x").limit(2 * docs * SAMPLE_WINDOWS * len(languages)).collect()
    if not rows:
        return languages, None
    number = {x: i for i, x in enumerate(languages)}
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(-1, LENGTH)
    return languages, train(x, np.array([number[r["lang"]] for r in rows]), len(languages))


def _some_windows(batches):
    """At most ``SAMPLE_WINDOWS`` windows of each text, spread evenly over the whole of it."""
    import pyarrow as pa

    for batch in batches:
        low = 0
        for keys, buf, offsets in text_chunks(batch, "key"):
            x, owner = windows(buf, offsets)
            count = np.bincount(owner, minlength=len(offsets) - 1)
            nth, of = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), count[owner]
            # The window is the first in its part of the text, if the text is cut into as many parts as windows are wanted.
            use = np.flatnonzero((nth * SAMPLE_WINDOWS // of) != ((nth - 1) * SAMPLE_WINDOWS // of))
            at = pa.array(owner[use])
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").slice(low, len(offsets) - 1).take(at), "key": keys.take(at), "x": pa.array([w.tobytes() for w in x[use]], pa.binary())})
            low += len(offsets) - 1


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    spark = documents.sparkSession
    languages, weights = fit(documents)
    model = spark.sparkContext.broadcast(weights)
    bounded_batches(spark)

    def run(batches):
        import pyarrow as pa

        network = Network(model.value) if model.value is not None else None
        for batch in batches:
            held = batch.column("held_out")
            low = 0
            for keys, buf, offsets in text_chunks(batch):
                n = len(offsets) - 1
                mean = np.zeros((n, max(1, len(languages))))
                x, owner = windows(buf, offsets)
                if network is not None and len(x):
                    q, count = network.probabilities(x), np.bincount(owner, minlength=n)
                    for c in range(len(languages)):
                        mean[:, c] = np.bincount(owner, q[:, c], n) / np.maximum(count, 1)
                best = mean.argmax(1)
                known = (np.diff(offsets) > 0) & (network is not None)
                score = np.clip(np.where(known, mean[np.arange(n), best], 0.0), 0.0, 1.0)
                yield pa.RecordBatch.from_pydict({"doc_id": keys, "held_out": held.slice(low, n), "lang_pred": pa.array([languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], pa.string()), "score": pa.array(score)})
                low += n

    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))  # without a letter: no language
    rows = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text.cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
