"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits.  Take a pair of fingerprints with three
differing bits or fewer, and leave out the segment where most of them are: no other segment has
two (that would make four), and not all three others have one (four again).  So one of them is
equal, and the other two differ in one bit at most.  The binary Golay code (23, 12, 7) is perfect: every
23-bit word lies within three bits of one codeword, so for words x, y at one bit or none, the
codeword of x is among the codewords of y and y's one-bit neighbours (about five).  A key is the
equal segment's bits with two codewords.  The left side registers the first of the two segments under its own
codeword and the second under those of its neighbours, the right side the other way round.
``KEYS`` names eight choices of segments of which every such pair fits one: each segment is left out
with two different equal ones, and is the equal one of two choices.  Pairs that meet are verified.

A fingerprint has about 85 keys of some 38 effective bits.  Fingerprints that meet by chance are about
112 N^2 / 2^38 for N different ones: fewer than the keys themselves up to 10^11.

Only distinct fingerprints are joined, so copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from . import words
from .common import as_docs, numbered
from .components import components

SEGMENT = 16  # bits
KEYS = [(e, *(k for k in range(4) if k not in (e, out))) for out in range(4) for e in ((out + 1) % 4, (out + 2) % 4)]  # (equal, two near ones)
MAX_BITS = 3
TEXTS = 500  # texts that a task handles at once


def fingerprints(col: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (unsigned 64-bit) of a batch of texts."""
    data, off = words.text_bytes(col, lower=True)
    starts, ends, first = words.spans(data, off)
    data, starts, ends = words.joined(data, starts, ends, first)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    # shingle j of a text: words j .. j + width - 1
    base = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    last = base + np.repeat(np.minimum(n, shingle), count) - 1
    h = words.xxh64_spans(data, starts[base], ends[last], seed)
    out = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    # bit counts in byte lanes: runs of up to 255 hashes of one text are summed as 64-bit numbers
    runs = np.concatenate([np.arange(begin[i], begin[i + 1], 255) for i in has])
    owner = np.searchsorted(begin[1:], runs, side="right")
    texts, at = np.unique(owner, return_index=True)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), runs)
        per = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
        over = (2 * per > count[texts][:, None]).astype(np.uint64)
        out[texts] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 high bits by the generator polynomial, and the error of each remainder."""
    generator = 0xC75  # fixed: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    def remainder(w: int) -> int:
        for k in range(22, 10, -1):
            if w >> k & 1:
                w ^= generator << (k - 11)
        return w
    high = np.array([remainder(m << 11) for m in range(1 << 12)], np.int64)
    error = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[remainder(e)] = e
    return high, error


def codeword(w: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    high, error = _golay()
    return (w ^ error[high[w >> 11] ^ (w & 0x7FF)]) >> 11


def _near_codewords(w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of each word and its one-bit neighbours: a sorted matrix and the mask of first occurrences."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    keys = np.sort(codeword(w[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, new


def _keys(left: bool):
    """fp -> (key, fp): the keys of one side, about 42 for each fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for c in range(0, len(all_fp), 2048):
                fp = all_fp[c:c + 2048]
                seg = [((fp.view(np.uint64) >> np.uint64(SEGMENT * k)) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64) for k in range(4)]
                own, near = [codeword(s) for s in seg], [_near_codewords(s, SEGMENT) for s in seg]
                key, who = [], []
                for n, (e, i, j) in enumerate(KEYS):
                    row, col = np.nonzero(near[j if left else i][1])
                    if left:
                        first, second = own[i][row], near[j][0][row, col]
                    else:
                        first, second = near[i][0][row, col], own[j][row]
                    key.append((n << 40) | (seg[e][row] << 24) | (first << 12) | second)
                    who.append(fp[row])
                yield pa.record_batch([pa.array(np.concatenate(key)), pa.array(np.concatenate(who))], names=["key", "fp"])
    return run


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """One row of every group, with the columns it came with: the smallest doc_id, null last, and of equal ones one row."""
    cols = docs.columns
    rows = numbered(docs)
    groups = simhash_groups(rows.select("row.doc_id", "row.text", "row_no"), carry=("row_no",), **options)
    keep = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).alias("first")).select("first.row_no")
    return rows.join(keep, "row_no", "left_semi").select(*[F.col(f"row.`{c}`") for c in cols])


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): all pairs a < b of the distinct fingerprints ``fp`` within ``max_bits`` (3 at most); a pair may come up to eight times.

    Both sides are exchanged by key, whatever the thresholds of the session: neither is broadcast."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find up to three differing bits")
    left = fps.select("fp").mapInArrow(_keys(True), "key long, fp long").select("key", F.col("fp").alias("a"))
    right = fps.select("fp").mapInArrow(_keys(False), "key long, fp long").select("key", F.col("fp").alias("b"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # a side's rows are some 42 to a fingerprint, which Spark doesn't know: by the size it assumes it would send a whole side to the driver
    return left.hint("merge").join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (far <= max_bits)).select("a", "b")


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, fingerprint, component_id, group): one row per input row.

    ``fingerprint`` is the majority vote of the XXH64 hashes of all lower-cased word shingles, as
    16 hex digits; ``component_id`` the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits.  Null, empty and white texts have fingerprint zero and link like
    any other; ``group`` is a number that the rows of a component share.  Texts shorter than a shingle are one shingle.  Null doc_ids stay null rows and
    never name a component (a component of only null ids has a null id); repeated doc_ids are
    treated row by row.  An empty table gives no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, len(batch), TEXTS):
                part = batch.slice(c, TEXTS)
                fp = fingerprints(part.column(len(cols)), shingle, seed)
                yield pa.record_batch([part.column(i) for i in range(len(cols))] + [pa.array(fp.view(np.int64))], names=[*cols, "fp"])

    cols = ("doc_id", *carry)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    rows = land(as_docs(docs, *cols, "text").mapInArrow(run, f"{kinds}, fp long"), "simhash")
    classes = land(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(near_links(classes, max_bits))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(groups, "root").select("fp", "component_id", F.col("root").alias("group"))
    return rows.join(named, "fp").select(*cols, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group")
