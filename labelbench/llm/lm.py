"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays.

Training counts words and pairs of words inside tasks, merges the counts per range of hashes and
writes each range as sorted arrays into the shared folder.  Scoring tasks map those files into
memory and look their tokens up by binary search, so the model may be larger than any worker's
memory and its pages are shared by the workers of a machine.

The order is two: a token's context is the token before it, the first token's the end token.
A pair is kept as a bijective hash of its two word numbers, so no two pairs are ever mixed up;
words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from . import hasharrays as H
from . import words
from .common import as_docs

U = np.uint64
END = words.hash_spans(np.array([10], np.uint8), np.array([0]), np.array([1]))[0]  # white space is no word
RANGE_BYTES = 32 << 20  # of text to a range of hashes
SEGMENT = 1 << 16  # words to a piece of the per-word arrays
FAN = 8  # ranges merged at once
TEXTS = 500  # texts that a task handles at once


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch with an end token behind every text, and the texts' first tokens (n + 1 numbers)."""
    data, off = words.text_bytes(col, lower=True)
    s, e, first = words.spans(data, off)
    h = words.hash_spans(data, s, e)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in range(0, len(batch), TEXTS):
            yield batch.slice(c, TEXTS)


def _scramble(x: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """A bijection of the numbers below 2 ** bits (bits even), and its inverse."""
    mask, half = U((1 << bits) - 1), U(bits // 2)
    factors = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    if back:
        for f in reversed(factors):
            x = x ^ (x >> half)
            x = (x * U(pow(f, -1, 1 << bits))) & mask
        return x
    for f in factors:
        x = (x * U(f & ((1 << bits) - 1))) & mask
        x = x ^ (x >> half)
    return x


@dataclass(frozen=True)
class Model:
    """Where the arrays are and the numbers that hold for the whole model."""

    folder: str
    vocab_sizes: list
    pair_sizes: list
    id_bits: int
    n_tokens: int
    pair_discounts: tuple
    word_discounts: tuple
    word_rest: float
    n_pairs: int

    @cached_property
    def n_vocab(self) -> int:
        return sum(self.vocab_sizes)

    @cached_property
    def vocab(self) -> H.HashArrays:
        return H.HashArrays(self.folder, "vocab", self.vocab_sizes)

    @cached_property
    def pairs(self) -> H.HashArrays:
        return H.HashArrays(self.folder, "pairs", self.pair_sizes, 2 * self.id_bits)

    @cached_property
    def _segments(self) -> np.ndarray:
        return np.arange(0, max(self.n_vocab, 1), SEGMENT)

    def word_array(self, what: str, ids: np.ndarray) -> np.ndarray:
        return H.gather(self.folder, f"words-%d-{what}", self._segments, ids)


def _ids(vocab: H.HashArrays, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word numbers of tokens (-1: unknown), in hash order, and each token's place among them."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    found = vocab.find(distinct)
    return found, inverse, distinct


def discounts(t: list[int]) -> tuple:
    """The three discounts from the numbers of entries seen once, twice, three and four times."""
    t1, t2, t3, t4 = (float(x) for x in t)
    if not (t1 and t2):
        return 0.5, 1.0, 1.5  # too little text to estimate them
    y = t1 / (t1 + 2 * t2)
    d1, d2 = 1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2
    d3 = 3 - 4 * y * t4 / t3 if t3 else d2
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate((d1, d2, d3), 1))


def _discount(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def train(docs: DataFrame) -> Model:
    """Count a model on all texts of ``docs`` (null: empty).  Runs jobs when called.

    An empty table gives a model without words, for which every token is unknown.
    """
    spark = docs.sparkSession
    texts = as_docs(docs, "text")
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_ranges = max(1, math.ceil(total / RANGE_BYTES))
    folder = H.mounted_folder(spark, "lm")

    def count_words(batches):
        counter = H.Counter(n_ranges)
        for part in _parts(batches):
            yield from counter.add(_tokens(part.column(0))[0])
        yield from counter.flush()

    def save_words(t: pa.Table) -> pa.Table:
        k = t["part"][0].as_py()
        keys, counts = H.merge(b.as_py() for b in t["blob"])
        H.save(folder, f"vocab-{k}-keys", keys)
        H.save(folder, f"vocab-{k}-counts", H.smallest(counts))
        return pa.table({"part": pa.array([k], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    rows = texts.mapInArrow(count_words, "part int, blob binary").groupBy("part") \
        .applyInArrow(save_words, "part int, n long, total long").collect()  # one row per range
    sizes, n_tokens = [0] * n_ranges, sum(r.total for r in rows)
    for r in rows:
        sizes[r.part] = r.n
    n_vocab = sum(sizes)
    bits = max(4, int(max(n_vocab - 1, 1)).bit_length())
    vocab = H.HashArrays(folder, "vocab", sizes)

    def count_pairs(batches):
        counter = H.Counter(n_ranges, 2 * bits)
        for part in _parts(batches):
            hashes, first = _tokens(part.column(0))
            found, inverse, distinct = _ids(vocab, hashes)
            ids = found[inverse].astype(U)
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[first[:-1]] = U(found[np.searchsorted(distinct, END)])
            yield from counter.add(_scramble((before << U(bits)) | ids, 2 * bits))
        yield from counter.flush()

    def save_pairs(t: pa.Table) -> pa.Table:
        k = t["part"][0].as_py()
        keys, counts = H.merge(b.as_py() for b in t["blob"])
        counts = counts.astype(np.int64)
        H.save(folder, f"pairs-{k}-keys", keys)
        H.save(folder, f"pairs-{k}-counts", H.smallest(counts))
        pair = _scramble(keys, 2 * bits, back=True)
        before, word = (pair >> U(bits)).astype(np.int64), (pair & U((1 << bits) - 1)).astype(np.int64)
        out = {"kind": ["size"], "part": [0], "n": [len(keys)], "blob": [np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64).tobytes()]}
        # what this range adds to the words' arrays, by segment of words
        adds = [(before[counts == 1], None, "n1"), (before[counts == 2], None, "n2"), (before[counts > 2], None, "n3"), (before, counts, "total"), (word, None, "left")]
        for who, weight, what in adds:
            who, n = H.count_keys(who.astype(U), weight)
            cut = np.flatnonzero(np.diff((who // U(SEGMENT)).astype(np.int64), prepend=-1))  # none where a range has no such pair
            for a, b in zip(cut, np.append(cut, len(who))[1:], strict=True):
                out["kind"].append(what)
                out["part"].append(int(who[a]) // SEGMENT)
                out["n"].append(0)
                out["blob"].append(H.pack(who[a:b], n[a:b]))
        return pa.table({"kind": out["kind"], "part": pa.array(out["part"], pa.int32()), "piece": pa.array([k] * len(out["n"]), pa.int32()),
                         "n": out["n"], "blob": pa.array(out["blob"], pa.binary())})

    def join_pieces(t: pa.Table) -> pa.Table:
        who, n = H.merge(b.as_py() for b in t["blob"])
        return pa.table({"kind": [t["kind"][0].as_py()], "part": t["part"][:1].cast(pa.int32()), "piece": pa.array([t["piece"][0].as_py() // FAN], pa.int32()),
                         "n": pa.array([0], pa.int64()), "blob": pa.array([H.pack(who, n)], pa.binary())})

    schema = "kind string, part int, piece int, n long, blob binary"
    found = land(texts.mapInArrow(count_pairs, "part int, blob binary").groupBy("part").applyInArrow(save_pairs, schema), "lm-pairs")
    pair_sizes, seen = [0] * n_ranges, np.zeros(4, np.int64)
    for r in found.filter("kind = 'size'").collect():  # one row per range
        pair_sizes[r.piece] = r.n
        seen += np.frombuffer(r.blob, np.int64)

    def save_segment(t: pa.Table) -> pa.Table:
        k, size = t["part"][0].as_py(), SEGMENT
        kinds = t["kind"].to_pylist()
        seen = np.zeros(5, np.int64)
        for what in ("n1", "n2", "n3", "total", "left"):
            x = np.zeros(size, np.int64)
            for kind, blob in zip(kinds, t["blob"], strict=True):
                if kind == what:
                    who, n = H.unpack(blob.as_py())
                    x[who.astype(np.int64) - k * size] += n.astype(np.int64)
            H.save(folder, f"words-{k}-{what}", H.smallest(x))
        seen = np.bincount(np.minimum(x, 5), minlength=6)[1:]
        return pa.table({"part": pa.array([k], pa.int32()), "seen": pa.array([seen.tolist()], pa.list_(pa.int64()))})

    # every range adds to every segment: a word's numbers of FAN ranges become one, until FAN pieces are left
    pieces, n_pieces = found.filter("kind <> 'size'"), n_ranges
    while n_pieces > FAN:
        by = ["kind", "part", F.floor(F.col("piece") / FAN)]
        pieces, n_pieces = land(pieces.groupBy(*by).applyInArrow(join_pieces, schema), "lm-pieces"), math.ceil(n_pieces / FAN)
    rows = pieces.groupBy("part").applyInArrow(save_segment, "part int, seen array<long>").collect()  # one row per 65,536 words
    left = np.sum([r.seen for r in rows], axis=0) if rows else np.zeros(5, np.int64)
    n_pairs = sum(pair_sizes)
    d = discounts(left[:4])
    rest = (d[0] * left[0] + d[1] * left[1] + d[2] * (left[2:].sum())) / n_pairs if n_pairs else 1.0
    return Model(folder, sizes, pair_sizes, bits, n_tokens, discounts(list(seen)), d, float(rest), n_pairs)


def _score_batch(model: Model, col: pa.Array) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score, score."""
    hashes, first = _tokens(col)
    vocab = model.vocab
    ids, inverse, distinct = _ids(vocab, hashes)
    counts = vocab.take(ids, "counts")
    v = model.n_vocab
    base = np.log10((counts + 0.1) / (model.n_tokens + 0.1 * (v + 1)))
    left = model.word_array("left", ids)
    low = np.maximum(left - _discount(left, model.word_discounts), 0) / max(model.n_pairs, 1) + model.word_rest / (v + 1)
    d = model.pair_discounts
    n1, n2, n3, total = (model.word_array(w, ids) for w in ("n1", "n2", "n3", "total"))
    before = np.empty(len(inverse), np.int64)
    before[1:] = inverse[:-1]
    before[first[:-1]] = np.searchsorted(distinct, END)
    p = low[inverse]
    both = np.flatnonzero((ids[inverse] >= 0) & (ids[before] >= 0))
    key = _scramble((ids[before[both]].astype(U) << U(model.id_bits)) | ids[inverse[both]].astype(U), 2 * model.id_bits)
    distinct_key, at = np.unique(key, return_inverse=True)
    pairs = model.pairs
    seen = np.zeros(len(inverse), np.int64)
    seen[both] = pairs.take(pairs.find(distinct_key), "counts")[at]
    safe = np.maximum(total, 1)
    share = (d[0] * n1 + d[1] * n2 + d[2] * n3) / safe
    context = total[before] > 0
    p = np.where(context, np.maximum(seen - _discount(seen, d), 0) / safe[before] + share[before] * p, p)
    exact = lambda x: np.add.reduceat(x.astype(np.longdouble), first[:-1]).astype(np.float64)
    return np.diff(first), np.add.reduceat((counts[inverse] > 0).astype(np.int64), first[:-1]), exact(base[inverse]), exact(np.log10(p))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, n_tokens, n_known, train_tokens, base_score, score, perplexity): one row per document.

    Null and empty texts are one end token; a very long text is read whole.  An empty table gives no row; carried
    columns keep their names, which must differ from the columns above.  Rows are scored one by one, repeated or null doc_ids
    too.  ``perplexity`` is 10 to the negative score per token.
    """
    cols = ("doc_id", *carry)

    def run(batches):
        for part in _parts(batches):
            n, known, base, log_p = _score_batch(model, part.column(len(cols)))
            yield pa.record_batch([part.column(i) for i in range(len(cols))] + [
                pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), model.n_tokens, np.int64)), pa.array(base), pa.array(log_p),
                pa.array(10 ** (-log_p / n))], names=[*cols, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return as_docs(docs, *cols, "text").mapInArrow(
        run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
