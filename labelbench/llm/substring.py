"""Exact removal of repeated passages by super-k-mer partitioning.

A window is 13 consecutive words.  Its minimiser is the smallest hash among its 4-word runs;
consecutive windows with the same minimiser travel to the minimiser's bucket as one packed
string of words.  In a bucket the windows are sorted, equal neighbours are compared byte by
byte, and every window gets the smallest doc_id it occurs in.

Documents are dealt to blocks of bounded bytes.  A block sends each distinct super-k-mer once,
with the smallest and the largest doc_id that hold it, so a passage that a third of all
documents share costs a bucket one string per block, not one per document.  A bucket answers
a block only for windows that some document of the block has to drop; the block finds the
places again by cutting its texts the same way.  The same exchange of the texts serves both.

A common run of words with a small hash would draw the windows of most documents into one
bucket.  So the bytes of all super-k-mers are first summed by cells, ``CELLS`` to a bucket, and
the windows of a cell above ``CELL_BYTES`` travel one by one, dealt to parts by a hash of all their
13 words.  The cells that stay whole bound a bucket by ``CELLS * CELL_BYTES``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import nullable, packed_row

U = np.uint64
WINDOW = 13
RUN = 4
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 6 << 20
CELLS = 16  # cells of minimiser hashes to a bucket
CELL_BYTES = 3 << 20  # of super-k-mers to a cell that is not split: eight times the mean
SPREAD = 3.2  # packed bytes per byte of text: a super-k-mer has 5.5 windows on average, and 12 words more than windows
TEXTS = 500  # texts that a task weighs at once
SAMPLE_TEXTS = 64  # texts whose beginnings prime the compression of the packed strings, which get short as buckets get many
LAST = np.iinfo(np.int64).max  # the rank of a null doc_id
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def run_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of runs of words (first word, number) from the words' hashes."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * _powers(_MUL, len(h)), dtype=U)])
    return words.mix((sums[start + length] - sums[start]) * _powers(_INV, len(h) + 1)[start])


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are the same for n bytes each."""
    at, same, todo, k = words.eights(data), np.ones(len(a), bool), np.arange(len(a)), 0
    while len(todo):
        left = n[todo] - k
        differ = ((at[a[todo] + k] ^ at[b[todo] + k]) & words._MASK[np.minimum(left, 8)]) != 0
        same[todo[differ]] = False
        k += 8
        todo = todo[~differ & (left > 8)]
    return same


def least_runs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, smallest hash of its runs) of every window of the texts."""
    n = np.diff(first)
    count = np.maximum(n - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(doc)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count)
    if not len(place):
        return place, doc, np.zeros(0, U)
    runs = run_hashes(h, np.arange(len(h) - RUN + 1), RUN)
    least = runs[place]
    for k in range(1, WINDOW - RUN + 1):
        np.minimum(least, runs[place + k], out=least)
    return place, doc, least


def _cells(least: np.ndarray, n_buckets: int) -> np.ndarray:
    return (words.mix(least * U(_MUL)) % U(n_buckets * CELLS)).astype(np.int64)


class Hot:
    """The cells whose windows travel one by one: cell numbers in order, and how many parts each is dealt to."""

    def __init__(self, cells=(), parts=()):
        order = np.argsort(np.array(cells, np.int64))
        self.cells, self.parts = np.array(cells, np.int64)[order], np.array(parts, np.int64)[order]
        self.first = np.concatenate([[0], np.cumsum(self.parts)]).astype(np.int64)

    def find(self, cell: np.ndarray) -> np.ndarray:
        """Place of every cell among these, -1 where it isn't one."""
        if not len(self.cells):
            return np.full(len(cell), -1)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, at, -1)


def hot_cells(docs: DataFrame, n_buckets: int) -> Hot:
    """Cells that all texts' super-k-mers, repeats included, give more than ``CELL_BYTES``.  Runs a job.

    To the driver comes one row per such cell: at most one per ``CELL_BYTES`` of super-k-mers, and of
    texts without very common runs none.
    """
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            cell, whole, alone = (np.concatenate(x) for x in zip(*held, strict=True))
            own, inverse = np.unique(cell, return_inverse=True)
            return own, *(np.bincount(inverse, x).astype(np.int64) for x in (whole, alone))

        def send():
            if held:
                yield pa.record_batch([pa.array(x) for x in merged()], names=["cell", "whole", "alone"])

        for batch in batches:
            for c in range(0, len(batch), TEXTS):
                raw, off = words.text_bytes(batch.column(0).slice(c, TEXTS))
                s, e, first = words.spans(raw, off)
                place, doc, least = least_runs(words.hash_spans(raw, s, e), first)
                if not len(place):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])]))
                last = np.append(begin[1:], len(place)) - 1
                upto = np.concatenate([[0], np.cumsum(e - s + 1)])
                held.append((_cells(least[begin], n_buckets), upto[place[last] + WINDOW] - upto[place[begin]],
                             np.add.reduceat(upto[place + WINDOW] - upto[place], begin)))
                size += len(begin)
                if size > 1_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield from send()
                        held, size = [], 0
        yield from send()

    sums = docs.select("text").mapInArrow(weigh, "cell long, whole long, alone long").groupBy("cell").agg(F.sum("whole").alias("whole"), F.sum("alone").alias("alone"))
    rows = sums.filter(F.col("whole") > CELL_BYTES).collect()
    return Hot([r.cell for r in rows], [math.ceil(r.alone / CELL_BYTES) for r in rows])


class Cut:
    """The super-k-mers of a batch of texts, grouped by content, in an order that is the same whenever it is made."""

    def __init__(self, ids: np.ndarray, col: pa.Array, n_buckets: int, hot: Hot):
        raw, off = words.text_bytes(col)
        s, e, self.first = words.spans(raw, off)
        self.data, self.start, self.end = words.joined(raw, s, e, self.first)
        self.n_words = np.diff(self.first)
        h = words.hash_spans(self.data, self.start, self.end)
        place, doc, least = least_runs(h, self.first)
        if not len(place):
            self.at = self.windows = self.doc = self.group = self.bucket = np.zeros(0, np.int64)
            self.turn = self.lead = np.zeros(0, np.int64)
            return
        new = np.ones(len(place), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
        cell = _cells(least[new], n_buckets)
        split = hot.find(cell)
        if (split >= 0).any():  # a window of a hot cell is a super-k-mer of its own
            of = np.cumsum(new) - 1
            new |= split[of] >= 0
            cell, split = cell[of[new]], split[of[new]]
        begin = np.flatnonzero(new)
        self.at = place[begin]  # first word
        self.windows = np.diff(np.append(begin, len(place)))
        self.doc = doc[begin]
        content = run_hashes(h, self.at, self.windows + (WINDOW - 1))
        bucket = cell // CELLS
        apart = np.flatnonzero(split >= 0)
        bucket[apart] = n_buckets + hot.first[split[apart]] + (words.mix(content[apart] ^ U(_MUL)) % hot.parts[split[apart]].astype(U)).astype(np.int64)
        order = np.lexsort((self.at, content, bucket))
        self.at, self.windows, self.doc, bucket, content = self.at[order], self.windows[order], self.doc[order], bucket[order], content[order]
        # equal super-k-mers next to each other form a group; two that only share a hash do not
        lo, hi = self.start[self.at], self.end[self.at + self.windows + WINDOW - 2]
        like = np.flatnonzero((bucket[1:] == bucket[:-1]) & (content[1:] == content[:-1]) & ((hi - lo)[1:] == (hi - lo)[:-1])) + 1
        like = like[same_spans(self.data, lo[like - 1], lo[like], (hi - lo)[like])]
        head = np.ones(len(order), bool)
        head[like] = False
        self.lead = np.flatnonzero(head)  # first member of each group
        self.group = np.cumsum(head) - 1
        self.bucket = bucket[self.lead]
        self.low = np.minimum.reduceat(ids[self.doc], self.lead)
        self.high = np.maximum.reduceat(ids[self.doc], self.lead)
        # a bucket's groups in the order of their first places, in which ids and words repeat more closely
        self.turn = np.lexsort((self.at[self.lead], self.bucket))


@cache
def _zstd(sample: bytes):
    primed = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(sample) > 64 else None
    return zstandard.ZstdCompressor(level=5, dict_data=primed), zstandard.ZstdDecompressor(dict_data=primed)


def _pack(sample: bytes, *arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return _zstd(sample)[0].compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(sample: bytes, blob: bytes, *kinds) -> list[np.ndarray]:
    raw = _zstd(sample)[1].decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:]
    ends = np.cumsum(np.concatenate([[8 * (len(kinds) + 1)], sizes]))
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(ends[:-1], ends[1:], kinds, strict=True)]


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(LAST).to_numpy()


def _ordered(docs: pa.Table) -> pa.Table:
    """A block's documents in an order that does not depend on how they arrived."""
    return docs.combine_chunks().sort_by([("row_no", "ascending")])


def _cutter(n_buckets: int, sample: bytes = b"", hot: Hot = Hot()):
    def cut(docs: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        c = Cut(_ids(docs["doc_id"]), docs["text"].combine_chunks(), n_buckets, hot)
        rows: dict[str, list] = {"bucket": [], "block": [], "blob": []}
        edges = np.flatnonzero(np.diff(c.bucket, prepend=-1))  # none where all texts of the block are short
        for a, b in zip(edges, np.append(edges, len(c.bucket))[1:], strict=True):
            group = c.turn[a:b]
            lead, low, high = c.lead[group], c.low[group], c.high[group]
            lo, hi = c.start[c.at[lead]], c.end[c.at[lead] + c.windows[lead] + WINDOW - 2] + 1  # with the space behind
            take = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            rows["bucket"].append(int(c.bucket[a]))
            rows["block"].append(docs["block"][0].as_py())
            rows["blob"].append(_pack(sample, np.diff(low, prepend=0), high - low, c.windows[lead].astype(np.int32), c.data[take]))
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array(rows["block"], pa.int32()),
                         "blob": pa.array(rows["blob"], pa.binary())})
    return cut


def _counter(sample: bytes = b""):
    def count(blobs: pa.Table) -> pa.Table:
        return _count_bucket(blobs, sample)
    return count


def _count_bucket(blobs: pa.Table, sample: bytes) -> pa.Table:
    """Smallest doc_id of every window of a bucket; per block, the windows that a document of it must drop."""
    parts = [_unpack(sample, b.as_py(), np.int64, np.int64, np.int32, np.uint8) for b in blobs["blob"]]
    n = np.array([len(p[0]) for p in parts])
    part, rank = np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n])
    low, high, windows = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    high = high + low
    data = np.concatenate([p[3] for p in parts])
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    h = words.hash_spans(data, start, end)
    at = np.concatenate([[0], np.cumsum(windows + (WINDOW - 1))[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    place = at[of] + inner
    key = run_hashes(h, place, WINDOW)
    order = np.argsort(key, kind="stable")
    lo, size = start[place], end[place + WINDOW - 1] - start[place]
    a, b = order[:-1], order[1:]
    equal = key[a] == key[b]
    maybe = np.flatnonzero(equal)
    same = (size[a[maybe]] == size[b[maybe]])
    same[same] = same_spans(data, lo[a[maybe[same]]], lo[b[maybe[same]]], size[a[maybe[same]]])
    if not same.all():  # different windows share a hash: sort those by their words
        runs = np.concatenate([[0], np.cumsum(~equal)])
        for r in np.unique(runs[maybe[~same] + 1]):
            member = order[runs == r]
            texts = [data[lo[i]:lo[i] + size[i]].tobytes() for i in member]
            by = sorted(range(len(member)), key=lambda i: texts[i])
            order[runs == r] = member[by]
            where = np.flatnonzero(runs == r)
            for k in range(1, len(by)):
                equal[where[k] - 1] = texts[by[k]] == texts[by[k - 1]]
    head = np.flatnonzero(np.concatenate([[True], ~equal]))
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[of[order]], head), np.diff(np.append(head, len(key))))
    drop = np.flatnonzero(least < high[of])
    owner = part[of[drop]]
    cuts = np.searchsorted(owner, np.arange(len(n) + 1))
    block, out = blobs["block"].to_numpy(), ([], [], [])
    for k in range(len(n)):
        d = drop[cuts[k]:cuts[k + 1]]
        if len(d):
            out[0].append(int(block[k]))
            out[1].append(blobs["bucket"][0].as_py())
            out[2].append(_pack(sample, rank[of[d]].astype(np.int32), inner[d].astype(np.int32), least[d]))
    return pa.table({"block": pa.array(out[0], pa.int32()), "bucket": pa.array(out[1], pa.int32()), "blob": pa.array(out[2], pa.binary())})


def _dropper(n_buckets: int, sample: bytes = b"", hot: Hot = Hot()):
    def drop(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        ids = _ids(docs["doc_id"])
        c = Cut(ids, docs["text"].combine_chunks(), n_buckets, hot)
        covered = np.zeros(len(c.start) + 1, np.int64)
        members = np.append(c.lead, len(c.at))
        for bucket, blob in zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True):
            rank, inner, least = _unpack(sample, blob, np.int32, np.int32, np.int64)
            group = c.turn[np.searchsorted(c.bucket, bucket) + rank]
            size = members[group + 1] - members[group]
            each = np.repeat(np.arange(len(group)), size)
            who = members[group][each] + np.arange(len(each)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            hit = least[each] < ids[c.doc[who]]
            place = c.at[who[hit]] + inner[each[hit]]
            np.add.at(covered, place, 1)
            np.add.at(covered, place + WINDOW, -1)
        keep = np.cumsum(covered[:-1]) == 0
        n_kept = np.add.reduceat(np.append(keep, False).astype(np.int64), c.first[:-1]) * (c.n_words > 0) if len(docs) else np.zeros(0, np.int64)
        length = (c.end - c.start + 1) * keep
        upto = np.concatenate([[0], np.cumsum(length)])
        size = upto[c.first[1:]] - upto[c.first[:-1]]
        body = c.data[np.repeat(keep, c.end - c.start + 1)]
        last = np.cumsum(size)[size > 0] - 1  # no space behind a text's last word
        body = np.delete(body, last)
        off = np.concatenate([[0], np.cumsum(size - (size > 0))])
        text = pa.LargeStringArray.from_buffers(len(docs), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
        return pa.table({"row": nullable(docs["row"]), "doc_id": docs["doc_id"], "text": docs["text"], "n_words": pa.array(c.n_words.astype(np.int64)),
                         "n_removed": pa.array((c.n_words - n_kept).astype(np.int64)), "kept_text": text})
    return drop


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text, n_words, n_removed, kept_text): ``row`` is a struct of the carried columns.

    ``kept_text`` joins by one space the words that no window covers whose words also occur in a
    document with a smaller doc_id.  Runs jobs when called (the bytes of all texts fix the number
    of blocks and buckets, the bytes of their super-k-mers the cells to split; the beginnings of a few
    texts prime the compression, nothing else).  Of one window a bucket gets one string per block,
    however many documents have it.  Null, empty and white texts: 0 words, kept_text empty.  Texts of fewer
    than 13 words lose nothing, very long ones are cut like any other, within one task.  A doc_id that is no number raises.  Null doc_ids rank last and remove nothing from each other; rows
    that repeat a doc_id do not count as smaller.  An empty table gives no row.  ``docs`` should be
    read from a table (rows are numbered as they are scanned).
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))
    n_buckets = max(1, math.ceil(total * SPREAD / BUCKET_BYTES))
    hot = hot_cells(docs, n_buckets)
    some = docs.select(F.substring("text", 1, 1800).alias("t")).filter("t <> ''").limit(SAMPLE_TEXTS).collect()
    sample = " ".join(sorted(r.t for r in some)).encode()
    row = packed_row(docs.select(*[F.col(f"`{c}`") for c in carry]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(row.alias("row"), "doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")
    sent = rows.groupBy("block").applyInArrow(_cutter(n_buckets, sample, hot), "bucket int, block int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_counter(sample), "block int, bucket int, blob binary")
    out = f"row {rows.schema['row'].dataType.simpleString()}, doc_id {kind}, text string, n_words long, n_removed long, kept_text string"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_dropper(n_buckets, sample, hot), out)
