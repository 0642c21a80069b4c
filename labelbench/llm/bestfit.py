"""Hierarchical residual packing.

Texts are tokenised as in ``packing`` (every distinct word once) and cut only where a text has more
tokens than a sequence.  Full pieces and residual pieces are items; items are dealt over blocks by a
hash of their number, and each block packs its own by best fit in falling order of length.  A bin
that is nearly full is finished.  The underfull bins of a block are items of the next round: groups
of ``FAN`` blocks merge into one, whose bins are packed by best fit again, until one group is left.

Best fit leaves a group at most one bin of half a sequence or less, as two of them would have
been one.  Bins above half never fit together, so all that later rounds can still do is to put
those small bins together or into a roomier bin.  ``FAN`` small bins meet in a round at most, so a
group hands on its small bin and its ``FAN`` roomiest others, and finishes the rest: a group of
any round holds ``FAN * (FAN + 1)`` items at most, however many documents there are and
whatever their lengths.

Where a bin went is one row per bin and round; the rounds' rows are joined from the top down and
then to the pieces.  The driver sees one number: how many pieces there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import as_docs
from .packing import token_batches, word_table

WINDOW = 4096
END_ID = 1
BLOCK = 16_384  # pieces to a block, about
FAN = 16  # groups that merge in a round
NEARLY_FULL = 16  # a bin with fewer free tokens than that is finished
PLACED = "kind int, item long, bin long, offset long"


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, row_no), landed.  Runs jobs.

    ``ids`` are compressed unsigned 32-bit little-endian numbers (``read_ids``), ``row_no`` numbers the pieces.
    """
    docs = as_docs(docs, "doc_id", "text")
    table, _ = word_table(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for part, flat, per in token_batches(table, tokenizer_path, batches, end_id):
            size = np.diff(per)
            n = -(-size // window)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * window
            length = np.minimum(size[row] - start, window)
            begin = per[row] + start
            raw = [flat[a:a + k].astype("<u4").tobytes() for a, k in zip(begin, length, strict=True)]
            yield pa.record_batch(
                [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                 pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([zip_.compress(x) for x in raw], pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return land(rows.withColumn("row_no", F.monotonically_increasing_id()), "fit-pieces")


def read_ids(blob: bytes) -> np.ndarray:
    """Token ids of a piece."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")


def best_fit(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items in falling order of size, each into the bin with the least room that takes it.

    Returns the bin and the offset of every item, and the fill of every bin.  The bins of each
    free size are a stack, and a number with one bit per free size tells the next one in use.
    """
    order = np.argsort(-sizes, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(window + 1)]
    used, fills, bins, offsets = 0, [], [0] * len(sizes), [0] * len(sizes)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = used >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                used ^= 1 << free
        else:
            b, free = len(fills), window
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        free -= size
        if not stacks[free]:
            used |= 1 << free
        stacks[free].append(b)
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(fills, np.int64)


def handed_on(fills: np.ndarray, window: int) -> np.ndarray:
    """Bins that a later round may still add to: the roomiest ``FAN`` above half, and what is not above half."""
    under = np.flatnonzero(fills <= window - NEARLY_FULL)
    under = under[np.argsort(fills[under], kind="stable")]
    small = int(np.searchsorted(fills[under], window // 2, side="right"))
    return under[:small + FAN]


def _pack_group(window: int, new_ids: bool):
    """Best fit over one group: rows of kind 0 place items, rows of kind 1 are the bins handed on."""
    def pack(t: pa.Table) -> pa.Table:
        group = t["group"][0].as_py()
        t = t.sort_by("item")
        items, sizes = t["item"].to_numpy(), t["size"].to_numpy()
        bins, offsets, fills = best_fit(sizes, window)
        if new_ids:
            name = (group << 32) + np.arange(len(fills))
        else:  # a merged bin goes by the bin that lies first in it
            name = np.zeros(len(fills), np.int64)
            name[bins[offsets == 0]] = items[offsets == 0]
        open_ = handed_on(fills, window)
        return pa.table({"kind": pa.array(np.repeat([0, 1], [len(items), len(open_)]), pa.int32()),
                         "item": np.concatenate([items, name[open_]]), "bin": np.concatenate([name[bins], name[open_]]),
                         "offset": np.concatenate([offsets, fills[open_]])})
    return pack


def place(items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(item, bin, offset) of (item, size) rows with distinct items and sizes of 1 to ``window``.  Runs jobs.

    ``items`` must give the same rows each time it is read (a landed table).
    """
    groups = max(1, -(-items.count() // block))
    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group"), "item", "size")
    rounds = [land(dealt.groupBy("group").applyInArrow(_pack_group(window, True), PLACED), "fit-round")]
    while groups > 1:
        groups = -(-groups // FAN)
        open_ = rounds[-1].filter("kind = 1").select(
            # a bin keeps the number of its first group, whose higher digits are the group of each later round
            F.floor(F.shiftright("bin", 32) / F.lit(FAN ** len(rounds))).cast("bigint").alias("group"), "item", F.col("offset").alias("size"))
        rounds.append(land(open_.groupBy("group").applyInArrow(_pack_group(window, False), PLACED), "fit-round"))
    out = rounds.pop().filter("kind = 0").drop("kind")
    while rounds:
        up = out.select(F.col("item").alias("bin"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
        out = rounds.pop().filter("kind = 0").join(up, "bin", "left").select(
            "item", F.coalesce("_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"))
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): documents in few sequences of at most ``window`` tokens.

    A document is its text's ids, then ``end_id``.  Only a longer one than a sequence is cut, into full
    sequences and a rest.  Null and empty texts, and those of white space alone, are the end id alone.  Repeated rows and
    rows of a null doc_id are documents of their own; ties of length go by the pieces' numbers.  A
    very long text is tokenised whole in one task and then as many pieces.  An empty table gives no
    rows.  Only doc_id and text are read, so other columns of any name do no harm.  Runs jobs.
    """
    rows = token_pieces(docs, tokenizer_path, window, end_id)
    at = place(rows.select(F.col("row_no").alias("item"), F.col("length").alias("size")), window, block)
    return rows.join(at, rows["row_no"] == at["item"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", F.col("bin").alias("sequence_id"), "offset")
