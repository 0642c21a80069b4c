"""Alignment of two tokenizers' tokens over a corpus.

Documents are shuffled by their full text; each distinct text is tokenised by both tokenizers and
aligned once, with the number of rows that hold it as its weight.  A block of distinct texts keeps
its tokens' overlaps (links) as indices into the block's distinct id pairs.  Weighted counts of id
pairs are summed over blocks; a block gets the counts of its own pairs back by one join and turns
them into measures of its texts.  A pair that occurs in every text is one row per block, never one
per text.  Measures go back to doc_ids the same way: a run of rows asks once for each text it
holds, so a text that a third of the rows hold is one row per run.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .packing import load_tokenizer

TEXTS = 512  # to a block, at most
TEXT_BYTES = 4 << 20  # to a block, about; a longer text is a block of its own
RUN = 65_536  # rows to a run
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
SPACE = "▁"


@cache
def load_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class TokenBytes:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@cache
def byte_level_bytes(path: str) -> TokenBytes:
    """Of a byte-level vocabulary: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = load_tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return TokenBytes(out)


@cache
def piece_bytes(path: str) -> TokenBytes:
    model = load_pieces(path)
    return TokenBytes([bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
                       for i in range(model.get_piece_size())])


def encode_both(texts: list[str], path_a: str, path_b: str) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of A for a space and the text, of B for the text; strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = load_tokenizer(path_a)
    if not a.encode_special_tokens:
        a.encode_special_tokens = True
    return [x.ids for x in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], load_pieces(path_b).encode(texts, num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.array(x, np.int64) for x in lists]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array([len(x) for x in parts], np.int64)


def _per_text(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over runs of ``size`` numbers."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    last = np.cumsum(size)
    return total[last] - total[last - size]


@cache
def _numerals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``n``, one row each with a place to spare, and how many."""
    width = len(str(n - 1))
    text = np.array([str(i) for i in range(n)], f"S{width + 1}")
    return text.view(np.uint8).reshape(n, width + 1), np.char.str_len(text)


def _group_strings(ids: np.ndarray, side: np.ndarray, last: np.ndarray, n_tokens: np.ndarray) -> list[str]:
    """Digests of texts' groups: tokens of both sides in order, ``last`` those that end their side of a group."""
    table, width = _numerals(1 << 17 if len(ids) and ids.max() >= 1 << 16 else 1 << 16)
    rows, n = table[ids].copy(), width[ids]
    rows[np.arange(len(ids)), n] = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
    flat = rows[np.arange(rows.shape[1]) <= n[:, None]].tobytes()
    size = _per_text(n + 1, n_tokens)
    end = np.cumsum(size)
    return [hashlib.sha256(flat[e - s:e - 1]).hexdigest() if s else "" for s, e in zip(size.tolist(), end.tolist(), strict=True)]


def align(texts: list[str], path_a: str, path_b: str) -> dict[str, np.ndarray | list]:
    """Tokens, groups and links of texts: numbers per text, and the id pair of every link in order.

    Every stretch between neighbouring ends of tokens of either side lies in one token of A and one
    of B, and every pair of overlapping tokens has one such stretch: those are the links.  Ends
    that both sides have end a group.  Texts whose tokens do not give back the text have none.
    """
    lists = encode_both(texts, path_a, path_b)
    kinds = byte_level_bytes(path_a), piece_bytes(path_b)
    raw = [b" " + t.encode() for t in texts]
    want = np.array([len(t) for t in raw], np.int64)
    good, sides = np.array([len(t) > 0 for t in texts], bool), []
    for ids, kind in zip(lists, kinds, strict=True):
        flat, n = _flat(ids)
        size = _per_text(kind.size[flat], n)
        good &= size == want
        sides.append((flat, n))
    # those of the right length are compared byte by byte
    expect = np.frombuffer(b"".join(t for t, ok in zip(raw, good, strict=True) if ok), np.uint8)
    same = np.ones(int(good.sum()), bool)
    for (flat, n), kind in zip(sides, kinds, strict=True):
        got = kind.of(flat[np.repeat(good, n)])
        same &= _per_text(got != expect, want[good]) == 0
    good[np.flatnonzero(good)[~same]] = False
    n_bytes = np.where(good, want, 0)
    ids, n_tokens, ends = [], [], []
    for (flat, n), kind in zip(sides, kinds, strict=True):
        flat = flat[np.repeat(good, n)]
        ids.append(flat)
        n_tokens.append(np.where(good, n, 0))
        ends.append(np.cumsum(kind.size[flat]))
    # ends as marks on the texts' bytes: what lies before an end is then a running count
    marks = [np.zeros(int(n_bytes.sum()) + 1, bool) for _ in ends]
    for mark, e in zip(marks, ends, strict=True):
        mark[e] = True
    cut = np.flatnonzero(marks[0] | marks[1])
    ends_here = [mark[cut] for mark in marks]
    shared = ends_here[0] & ends_here[1]
    before = lambda x: np.cumsum(x) - x
    group_at, both = before(shared), cut[shared]
    text_end = np.cumsum(n_bytes)
    n_links = np.diff(np.searchsorted(cut, text_end, side="right"), prepend=0)
    n_groups = np.diff(np.searchsorted(both, text_end, side="right"), prepend=0)
    pair = [x[before(e)] for x, e in zip(ids, ends_here, strict=True)]
    # tokens of both sides in one order: by group, then side, then place
    group = [group_at[e] for e in ends_here]
    last = [np.append(g[1:] != g[:-1], True)[:len(g)] for g in group]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])[order]
    digests = _group_strings(np.concatenate(ids)[order], side, np.concatenate(last)[order], n_tokens[0] + n_tokens[1])
    return {"n_a": n_tokens[0], "n_b": n_tokens[1], "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests,
            "pairs": pair[0] << 32 | pair[1]}


def _blocks(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """Rows in groups of at most ``texts`` and about ``TEXT_BYTES``."""
    for batch in batches:
        size = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
        a = 0
        while a < len(batch):
            b = int(np.searchsorted(size, (size[a - 1] if a else 0) + TEXT_BYTES, side="right"))
            b = min(max(b, a + 1), a + texts, len(batch))
            yield batch.slice(a, b - a)
            a = b


def _shrink(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _grow(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def text_key(text: str = "text"):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block of distinct texts: their keys, multiplicities and measures, and the links.  Runs jobs."""
    distinct = docs.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, TEXTS):
            got = align(block.column("text").to_pylist(), path_a, path_b)
            codes, inverse = np.unique(got.pop("pairs"), return_inverse=True)
            weight = np.bincount(inverse, np.repeat(block.column("n").to_numpy(), got["n_links"]), len(codes)).astype(np.int64)
            lists = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.record_batch(
                [lists(block.column("key").to_pylist(), pa.binary()), lists(got["groups_sha256"], pa.string()),
                 *[lists(got[c], pa.int64()) for c in MEASURES[:4]], lists(codes, pa.int64()), lists(weight, pa.int64()),
                 pa.array([_shrink(inverse)], pa.binary())],
                names=["key", "groups_sha256", *MEASURES[:4], "codes", "weights", "links"])

    schema = "key array<binary>, groups_sha256 array<string>, " + ", ".join(f"{c} array<long>" for c in MEASURES[:4]) \
        + ", codes array<long>, weights array<long>, links binary"
    blocks = distinct.withColumn("key", text_key()).mapInArrow(run, schema)
    return land(blocks.withColumn("block", F.monotonically_increasing_id()), "align-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, count, best): every linked id pair of the corpus, and whether no pair of its B id has more.  Runs a job."""
    cells = blocks.select(F.explode(F.arrays_zip("codes", "weights")).alias("c"))
    counts = land(cells.groupBy(F.col("c.codes").alias("code")).agg(F.sum("c.weights").alias("count")), "align-pairs")
    b = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    top = counts.groupBy(b).agg(F.max("count").alias("top"))  # at most one row per id of B
    return counts.withColumn("b", b).join(top, "b").select("code", "count", (F.col("count") == F.col("top")).alias("best"))


def _measure(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """Measures of a block's texts, from the counts of its pairs."""
    row = {c: blocks[c][0] for c in blocks.column_names}
    codes = row["codes"].values.to_numpy()
    order = np.argsort(counts["code"].to_numpy())
    count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
    assert len(count) == len(codes)
    links, n_links = _grow(row["links"].as_py()), row["n_links"].values.to_numpy()
    own = {"n_best": _per_text(best[links], n_links), "count_sum": _per_text(count[links], n_links)}
    cols = {"key": row["key"].values, "groups_sha256": row["groups_sha256"].values} | {c: row[c].values for c in MEASURES[:4]} | own
    return pa.table(cols)


def token_alignment(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Measures of every row of ``docs``, and the corpus' (code, count, best) of id pairs ``a << 32 | b``.

    The first has doc_id, ``MEASURES`` and groups_sha256.  Rows of null and empty texts, and of texts that a
    tokenizer does not give back byte by byte, have zeros and ''.  Repeated rows stay, each with its
    text's measures, and count as often as they occur; a null doc_id is a row like any other.  Pairs of one B id
    with equal counts are all its best.  A very long text is a block of its own in one task.  An
    empty table gives no rows.  Only doc_id and text are read.  Runs jobs.
    """
    docs = docs.select("doc_id", "text")
    rows = land(docs.select("doc_id", F.when(F.col("text") != "", text_key()).alias("key"))
                .withColumn("row_no", F.monotonically_increasing_id()), "align-rows")
    rows = rows.withColumn("run", F.floor(F.col("row_no") / RUN))
    blocks = aligned_texts(docs, path_a, path_b)
    counts = land(pair_counts(blocks), "align-counts")
    asked = blocks.select(F.col("block").alias("by"), F.explode("codes").alias("code")).join(counts, "code")
    schema = "key binary, groups_sha256 string, " + ", ".join(f"{c} long" for c in MEASURES)
    texts = blocks.drop("weights").groupBy("block").cogroup(asked.groupBy("by")).applyInArrow(_measure, schema)
    held = rows.filter("key IS NOT NULL").select("run", "key").distinct().join(land(texts, "align-texts"), "key")
    out = rows.join(held, ["run", "key"], "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return out, counts
