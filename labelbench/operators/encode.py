"""Token encoding job: built vocabulary and fixed-length id arrays.

The pretrained word-piece vocabulary of the studied model is replaced by a vocabulary built
from the data (whole texts): tokens are counted with a partially aggregated ``groupBy``
(a very frequent token collapses map-side) and numbered densely in a seeded hash order with
the two-level rank, so no step orders the whole vocabulary in one task.

Encoding sends no cells through a shuffle.  Texts are tokenised once and landed in blocks of rows;
a block asks once for each distinct token it holds, so a token of every text is one row per block, and
gets the ids back beside its rows, where Arrow's hash look-up maps the cells.

The fixed length ``max_len`` is the encoder's specification (``truncation=True``): a row
keeps its first ``max_len - 2`` tokens between [CLS] and [SEP]; ``n_tokens`` counts the
whole text.

Sub-words: a word is cut into the longest pieces of a vocabulary from its left, pieces inside a word
being marked as such; a word with a place that no piece fits, or of over ``WORD_CHARS`` characters, is one
[UNK].  ``build_pieces`` makes a vocabulary of at most ``size`` pieces by rule: the characters, then
the most frequent words.  No merges are trained.  Only distinct words are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import land
from .split import hash_rank

PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_WORD_ID = 4
VOCAB_SEED = 0
BLOCK = 512  # rows to a block
WORD_CHARS = 100


def tokenised(df: DataFrame, text_col: str = "description", id_col: str = "row_id") -> DataFrame:
    """(row_id, tokens, block), landed: the one pass over the texts that the vocabulary and the ids share.  Runs a job."""
    block = F.floor(F.monotonically_increasing_id() / BLOCK).cast("bigint").alias("block")
    return land(df.select(id_col, tokens(text_col).alias("tokens"), block), "tokens")


def _tokens(df: DataFrame, text_col: str) -> Column:
    return F.col("tokens") if "tokens" in df.columns else tokens(text_col)


def build_vocab(df: DataFrame, text_col: str = "description", min_count: int = 1) -> DataFrame:
    """(token, token_id, count) over every token of every text, or of a ``tokenised`` table.  Runs a job."""
    counts = (df.select(F.explode(_tokens(df, text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    if min_count > 1:
        counts = counts.filter(F.col("count") >= min_count)
    # the rank reads the counts twice (bucket sizes, then numbering): land them so the texts
    # are tokenised and counted once
    ranked = hash_rank(land(counts, "vocab_counts"), VOCAB_SEED, id_col="token").drop("_group_n")
    return ranked.select("token", (F.col("rank") + (FIRST_WORD_ID - 1)).cast("int").alias("token_id"), "count")


def _encode_block(max_len: int, id_col: str):
    """Fixed-length ids of a block's rows, from the ids of its distinct tokens."""
    body = max_len - 2

    def encode(rows: pa.Table, known: pa.Table) -> pa.Table:
        lists = rows["tokens"].combine_chunks()
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = lists.flatten().take(pa.array(_ranges(np.cumsum(n) - n, np.minimum(n, body))))
        n = np.minimum(n, body)
        place = pc.index_in(cells, value_set=known["token"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = known["ids"].combine_chunks()
        size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten().to_numpy()[_ranges((np.cumsum(size) - size)[place], size[place])] if len(place) else np.zeros(0, np.int32)
        total = np.concatenate([[0], np.cumsum(size[place])]) if len(place) else np.zeros(1, np.int64)
        first, last = total[np.cumsum(n) - n], total[np.cumsum(n)]
        kept = np.minimum(last - first, body)
        out, mask = np.full((len(n), max_len), PAD, np.int32), np.zeros((len(n), max_len), np.int32)
        row = np.repeat(np.arange(len(n)), kept)
        out[row, 1 + _ranges(np.zeros_like(kept), kept)] = flat[_ranges(first, kept)]
        out[:, 0] = CLS
        out[np.arange(len(n)), kept + 1] = SEP
        mask[np.arange(max_len) < (kept + 2)[:, None]] = 1
        fixed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max_len), pa.int32()), pa.array(x.reshape(-1)))
        return pa.table({id_col: rows[id_col], "input_ids": fixed(out), "attention_mask": fixed(mask),
                         "token_type_ids": fixed(np.zeros_like(mask)), "n_tokens": rows["n_tokens"]})
    return encode


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _encode(df: DataFrame, words: DataFrame, max_len: int, text_col: str, id_col: str) -> DataFrame:
    """Encode with ``words`` (token, ids): a token that is not there is [UNK]."""
    toks = df if "block" in df.columns else tokenised(df, text_col, id_col)
    asked = toks.select(F.col("block").alias("by"), F.explode(F.slice("tokens", 1, max_len - 2)).alias("token")).distinct()
    known = asked.join(words, "token", "left").select("by", "token", F.coalesce("ids", F.array(F.lit(UNK))).alias("ids"))
    rows = toks.select(id_col, "tokens", F.size("tokens").alias("n_tokens"), "block")
    kind = toks.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>, n_tokens int"
    return rows.groupBy("block").cogroup(known.groupBy("by")).applyInArrow(_encode_block(max_len, id_col), schema)


def encode_tokens(df: DataFrame, vocab: DataFrame, max_len: int = 300, text_col: str = "description",
                  id_col: str = "row_id") -> DataFrame:
    """(row_id, input_ids, attention_mask, token_type_ids, n_tokens), arrays of ``max_len``, of texts or
    of a ``tokenised`` table (a job lands one where texts are given)."""
    return _encode(df, vocab.select("token", F.array(F.col("token_id").cast("int")).alias("ids")), max_len, text_col, id_col)


def build_pieces(vocab: DataFrame, size: int = 30_000) -> DataFrame:
    """(piece, inside, piece_id) of at most ``size`` pieces: characters, then words, the most frequent first.

    ``vocab`` has (token, count).  A word is a piece at a word's beginning and, marked ``inside``, also in one.
    """
    chars = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(F.substr(F.col("token"), i, F.lit(1)).alias("piece"), (i > 1).alias("inside")))
    one = vocab.select(F.explode(chars).alias("c"), "count").groupBy("c.piece", "c.inside").agg(F.sum("count").alias("count")).withColumn("word", F.lit(0))
    many = vocab.filter(F.length("token") > 1).select(F.col("token").alias("piece"), F.explode(F.array(F.lit(False), F.lit(True))).alias("inside"), "count", F.lit(1).alias("word"))
    order = ["word", F.desc("count"), "piece", "inside"]
    most = one.select("piece", "inside", "count", "word").unionByName(many).orderBy(*order).limit(size)  # bounded by ``size``
    return most.select("piece", "inside", (F.row_number().over(Window.orderBy(*order)) + (FIRST_WORD_ID - 1)).alias("piece_id"))


def cut_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(token, ids) of distinct words: the longest piece first, from the left.

    Every task holds the piece table, which ``build_pieces`` bounds.  Runs a job.
    """
    table = {(r.inside, r.piece): r.piece_id for r in pieces.collect()}
    longest = max((len(p) for _, p in table), default=0)

    def cut(word: str) -> list[int]:
        out, at = [], 0
        while at < len(word) <= WORD_CHARS:
            for end in range(min(len(word), at + longest), at, -1):
                if (found := table.get((at > 0, word[at:end]))) is not None:
                    break
            else:
                return [UNK]
            out.append(found)
            at = end
        return out or [UNK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([cut(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["token", "ids"])

    return words.select("token").mapInArrow(run, "token string, ids array<int>")


def encode_subwords(df: DataFrame, vocab: DataFrame, pieces: DataFrame, max_len: int = 300, text_col: str = "description",
                    id_col: str = "row_id") -> DataFrame:
    """As ``encode_tokens``, in pieces of words; ``n_tokens`` still counts the text's words.  Runs a job."""
    return _encode(df, cut_words(vocab, pieces), max_len, text_col, id_col)
