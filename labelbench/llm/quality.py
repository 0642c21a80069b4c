"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of 64 words.  Every passage is encoded as a short vector (surface
statistics, repetition, and how strongly its words speak for either label); a gated attention
learns from the document labels alone which passages matter, and the weighted passage
representation is scored.  Features come from the text only.

Training reads a bounded sample of labelled documents (``sample`` rows, whole texts, and at most
``passages`` passages for the network), picked by the hash of their id: one half gives the words' log-odds, the other half trains the network, so
that a word seen once cannot vouch for its own document.  Scoring is one pass over all whole
texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from . import words
from .common import as_docs, n_words, nullable

U = np.uint64
PASSAGE = 64
LEXICON_BITS = 16
SAMPLE = 16_000  # labelled documents learned from
SAMPLE_PASSAGES = 1 << 19  # passages that the network learns from: 38 MB of vectors
TEXTS = 300
HIDDEN, GATE = 24, 12

_CLASS = {name: np.zeros(256, bool) for name in ("symbol", "shout", "upper", "digit", "stop", "high", "slash")}
_CLASS["symbol"][list(b"#*$%&|<>{}[]\\^~_=+@")] = True
_CLASS["shout"][list(b"!")] = True
_CLASS["upper"][65:91] = True
_CLASS["digit"][48:58] = True
_CLASS["stop"][list(b".?!")] = True
_CLASS["high"][128:] = True
_CLASS["slash"][list(b"/:;,()\"'")] = True


def _words(col: pa.Array):
    data, off = words.text_bytes(col)
    s, e, first = words.spans(data, off)
    data, s, e = words.joined(data, s, e, first)
    return data, s, e, first, words.hash_spans(words._LOWER[data], s, e)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (words.mix(h) >> U(64 - LEXICON_BITS)).astype(np.int64)


def encode(col: pa.Array, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of a batch of texts and each text's first passage (n + 1 numbers).

    A text without words is one passage of zeros with the first column 1.
    """
    data, s, e, first, h = _words(col)
    n = np.diff(first)
    count = np.maximum(-(-n // PASSAGE), 1)
    bag = np.concatenate([[0], np.cumsum(count)])
    x = np.zeros((bag[-1], 18))
    empty = np.repeat(n == 0, count)
    x[empty, 0] = 1
    full = np.flatnonzero(~empty)
    if not len(full):
        return x, bag
    doc = np.repeat(np.arange(len(n)), count)[full]
    start = first[doc] + PASSAGE * (full - bag[doc])
    size = np.minimum(start + PASSAGE, first[doc + 1]) - start
    byte = s[start]
    length = np.add.reduceat(e - s, start)
    x[full, 1] = np.log1p(size) / 4
    x[full, 2] = length / size / 8
    for k, of in enumerate(_CLASS.values()):
        per = np.add.reduceat(of[data], byte, dtype=np.int64)
        x[full, 3 + k] = np.log1p(8 * per / length)
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][n > 0]] = 0
    x[full, 10] = np.add.reduceat(same, start) / size
    # words that the passage, or the document, has already had
    owner = np.repeat(np.arange(len(full)), size)
    for k, group in ((11, owner), (12, doc[owner])):
        order = np.lexsort((np.arange(len(h)), h, group))
        again = np.zeros(len(h))
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        x[full, k] = np.add.reduceat(again, start) / size
    odds = lexicon[_bucket(h)]
    x[full, 13] = np.add.reduceat(odds, start) / size
    x[full, 14] = np.minimum.reduceat(odds, start) / 4
    x[full, 15] = np.maximum.reduceat(odds, start) / 4
    x[full, 16] = np.add.reduceat(np.minimum(odds, 0), start) / 8
    x[full, 17] = np.log1p(n[doc]) / 8
    return x, bag


@dataclass
class Model:
    lexicon: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: dict

    def score(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the probability of label 1, the number of passages, the largest attention weight."""
        x, bag = encode(col, self.lexicon)
        p, a, _ = _forward((x - self.mean) / self.scale, bag[:-1], np.diff(bag), self.weights)
        return p, np.diff(bag), np.maximum.reduceat(a, bag[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _forward(x: np.ndarray, begin: np.ndarray, size: np.ndarray, w: dict):
    h = np.maximum(x @ w["W"] + w["w0"], 0)
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), size))
    a = e / np.repeat(np.add.reduceat(e, begin), size)
    z = np.add.reduceat(a[:, None] * h, begin)
    return _sigmoid(z @ w["c"] + w["c0"]), a, (h, t, g, z)


def _gradients(x, y, begin, size, w, decay):
    p, a, (h, t, g, z) = _forward(x, begin, size, w)
    d = (p - y) / len(y)
    dz = np.repeat(d[:, None] * w["c"], size, axis=0)
    da = (h * dz).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, begin), size))
    dt, dg = de[:, None] * g * w["a"] * (1 - t * t), de[:, None] * t * w["a"] * g * (1 - g)
    dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (h > 0)
    grad = {"W": x.T @ dh, "w0": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ d, "c0": d.sum(keepdims=True)}
    return {k: v + (decay * w[k] if w[k].ndim > 1 else 0) for k, v in grad.items()}


def fit(x: np.ndarray, size: np.ndarray, y: np.ndarray, epochs: int = 30, step: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adam over mini-batches of 128 bags; x has the passages of all bags end to end."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    w = {"W": rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), "w0": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)),
         "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "a": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "c0": np.zeros(1)}
    m, v, k = {i: np.zeros_like(j) for i, j in w.items()}, {i: np.zeros_like(j) for i, j in w.items()}, 0
    begin = np.concatenate([[0], np.cumsum(size)])
    steps = epochs * max(1, len(y) // 128)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for c in range(0, len(y), 128):
            b = order[c:c + 128]
            inner = np.concatenate([[0], np.cumsum(size[b])])
            take = np.repeat(begin[b] - inner[:-1], size[b]) + np.arange(inner[-1])
            k += 1
            rate = step * max(0.05, 1 - k / steps)
            for i, g in _gradients(x[take], y[b], inner[:-1], size[b], w, decay).items():
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.999 ** k)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Model:
    """Learn from (doc_id, quality) rows; null labels are left out.  Runs jobs when called.

    Of more than ``sample`` labelled ids those with the smallest hashes are read, and of rows of one
    id the one whose text has the smallest hash (``sample`` bounds what is broadcast, the rows
    learned from and what reaches the driver).  The network learns from whole documents of together at
    most ``passages`` passages, in the order of the hashes; a document longer than an eighth of that is left to
    the words' log-odds.  Null, empty and white texts are learned as a bag of one empty passage.  Without labels,
    and of empty tables, every score is 0.5.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    picked = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("pick", F.xxhash64("doc_id")) \
        .orderBy("pick", "doc_id").limit(sample)
    picked = land(picked, "quality-labels")
    texts = as_docs(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id") \
        .groupBy("doc_id", "quality", "pick").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")) \
        .select("doc_id", "pick", "text", "quality", F.pmod("pick", F.lit(2)).alias("half"))
    texts = land(texts, "quality-texts")  # the sample only

    def lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << LEXICON_BITS), np.int64)
        for batch in batches:
            for c in range(0, len(batch), TEXTS):
                part = batch.slice(c, TEXTS)
                *_, first, h = _words(part.column(0))
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                once = np.unique((doc << LEXICON_BITS) | _bucket(h))
                label = part.column(1).to_numpy()[once >> LEXICON_BITS]
                for y in (0, 1):
                    total[y] += np.bincount(once[label == y] & ((1 << LEXICON_BITS) - 1), minlength=1 << LEXICON_BITS)
        y, b = np.nonzero(total)
        yield pa.record_batch([pa.array(y.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[y, b])], names=["quality", "bucket", "n"])

    seen = texts.filter("half = 0").select("text", "quality").mapInArrow(lexicon, "quality int, bucket int, n long") \
        .groupBy("quality", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 131,072 rows
    df = np.zeros((2, 1 << LEXICON_BITS))
    df[seen["quality"].to_numpy(), seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    bags = {r.quality: r["count"] for r in texts.filter("half = 0").groupBy("quality").count().collect()}
    n0, n1 = bags.get(0, 0) + 1, bags.get(1, 0) + 1
    prior = 10.0  # documents' worth of doubt for every word
    p0 = (n0 / (n0 + n1))
    odds = np.log((df[1] + prior * (1 - p0)) / (1 - p0)) - np.log((df[0] + prior * p0) / p0)
    odds = np.where(df.sum(axis=0) >= 3, odds, 0.0)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, len(batch), TEXTS):
                part = batch.slice(c, TEXTS)
                x, bag = encode(part.column(0), odds)
                blobs = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bag[:-1], bag[1:], strict=True)]
                yield pa.record_batch([pa.array(blobs, pa.binary()), part.column(1)], names=["x", "quality"])

    # at most half of ``sample`` rows of numbers; the texts stay where they are
    sizes = texts.filter("half = 1").select("doc_id", "pick", F.greatest(F.ceil(n_words(F.col("text")) / PASSAGE), F.lit(1)).alias("n")).filter(F.col("n") * 8 <= passages)
    fits = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("pick", "doc_id"))).filter(F.col("upto") <= passages).select("doc_id")
    got = texts.join(F.broadcast(fits), "doc_id", "left_semi").select("text", "quality").mapInArrow(bagged, "x binary, quality int").toArrow()  # at most ``passages`` vectors
    blobs = sorted(zip(got["x"].to_pylist(), got["quality"].to_pylist(), strict=True))  # an order that reruns share
    if not blobs:
        return Model(odds, np.zeros(18), np.ones(18), {"W": np.zeros((18, HIDDEN)), "w0": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, GATE)),
                                                       "U": np.zeros((HIDDEN, GATE)), "a": np.zeros(GATE), "c": np.zeros(HIDDEN), "c0": np.zeros(1)})
    parts = [np.frombuffer(b, np.float32).reshape(-1, 18) for b, _ in blobs]
    x, size, y = np.concatenate(parts).astype(float), np.array([len(p) for p in parts]), np.array([float(q) for _, q in blobs])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return Model(odds, mean, scale, fit((x - mean) / scale, size, y))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, score, n_passages, top_attention): one row per document.

    ``score`` is the model's probability of label 1, from the whole text.  Null, empty and white
    texts are a bag of one empty passage.  Very long texts are scored whole, in one task, with 144 bytes
    for every 64 words.  Rows with null or repeated doc_ids are scored like any; equal texts have equal scores.  An
    empty table gives no row.
    """
    cols = ("doc_id", *carry)
    every = (*cols, "text") if "text" not in cols else cols
    text = every.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, len(batch), TEXTS):
                part = batch.slice(c, TEXTS)
                p, n, top = model.score(part.column(text))
                yield pa.record_batch([nullable(part.column(i)) for i in range(len(cols))] + [pa.array(p), pa.array(n.astype(np.int32)), pa.array(top)],
                                      names=[*cols, "score", "n_passages", "top_attention"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return as_docs(docs, *every).mapInArrow(run, f"{kinds}, score double, n_passages int, top_attention double")
