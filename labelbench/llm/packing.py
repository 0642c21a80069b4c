"""Lexical retrieval packing.

Texts are tokenised once per distinct word: tasks collect their distinct words, each is
tokenised in one place, and the word -> ids table is kept as memory-mapped sorted hash arrays
(with a second hash to tell a strange word from a known one).  Document frequencies, the number of
documents and their mean length are counted over all documents.  The BM25 inverted index is kept
as memory-mapped blocks of bounded size, and every seed document queries all of them with all
its words; as documents are used up, the blocks are written anew without them.  Packing goes in rounds: seeds ask for their best unused neighbours in the corpus,
a document that several want goes to the one that ranks it highest, and a seed whose window fills
gives a sequence, the last document cut where it is full.  What is left of a cut document is a
seed of the next round; a seed that lost too many of its neighbours asks again.  The last
``SHARD_TOKENS`` tokens are packed one seed after the other.  Only the very last sequence stays short,
and it is split into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from . import hasharrays as H
from . import words
from .common import as_docs

U = np.uint64
END_ID = 2
WINDOW = 4096
SHARD_TOKENS = 1 << 20  # of the rest that is packed at once
SHARDS = 2  # times that many tokens to a block of the index
SHARD_DOCS = 8192  # documents to a block, at most
SEEDS = 3072  # of a round, at most
SEED_BLOCK = 256  # seeds to a task
ASKED = 768  # neighbours that a seed asks for in a round: many, as seeds want the same ones
RANGE_BYTES = 8 << 20  # of text to a range of word hashes
TEXTS = 500
PIECES = 300  # pieces that a task hands over at once
K1, B = 1.2, 0.75


# Words of letters, with or without a run of marks behind: the tokenizer splits them into one or two parts.  No
# apostrophe, as it has rules of its own for those.
PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+([.,;:!?|*&%$#]*)")
TOGETHER = 400  # words that are tokenised as one text


@cache
def load_tokenizer(path: str):
    """One per process; a task is one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def word_ends(path: str) -> np.ndarray:
    """Which ids end a part of a word."""
    vocab = load_tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = token.endswith("</w>")
    return out


def encode_words(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words end to end, and how many each has.

    Plain words are tokenised many at a time, with spaces between, and told apart by the ids that
    end a part; a count of parts that does not fit, and any other word, is tokenised by itself.
    """
    tokenizer, ends = load_tokenizer(path), word_ends(path)
    encode = lambda some: [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    parts = np.array([0 if m is None else 2 if m[1] else 1 for m in map(PLAIN.fullmatch, texts)], np.int64)
    size, pieces, alone = np.zeros(len(texts), np.int64), [], list(np.flatnonzero(parts == 0))
    plain = np.flatnonzero(parts)
    for c in range(0, len(plain), 20 * TOGETHER):
        groups = [plain[a:a + TOGETHER] for a in range(c, min(c + 20 * TOGETHER, len(plain)), TOGETHER)]
        for group, ids in zip(groups, encode([" ".join([texts[i] for i in g]) for g in groups]), strict=True):
            stop, last = np.flatnonzero(ends[ids]), np.cumsum(parts[group]) - 1
            if len(stop) != last[-1] + 1 or stop[-1] != len(ids) - 1:
                alone.extend(group)
                continue
            size[group] = np.diff(stop[last] + 1, prepend=0)
            pieces.append((group, ids))
    for c in range(0, len(alone), 2000):
        group = np.array(alone[c:c + 2000])
        ids = encode([texts[i] for i in group])
        size[group] = [len(x) for x in ids]
        pieces.append((group, np.concatenate(ids)))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(first[-1], np.uint32)
    for group, ids in pieces:
        out[np.repeat(first[group] - np.concatenate([[0], np.cumsum(size[group])[:-1]]).astype(np.int64), size[group]) + np.arange(len(ids))] = ids
    return out, size


def _read(col: pa.Array):
    """Words of a batch and two hashes; upper case A-Z counts as lower case (the tokenizer lowers it anyway) unless the
    batch holds a mark of special tokens, which are case-sensitive."""
    data, off = words.text_bytes(col)
    if b"<|" not in data.tobytes():
        data = words._LOWER[data]
    s, e, first = words.spans(data, off)
    return data, s, e, first, words.hash_spans(data, s, e)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    head = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]) if len(h) else np.zeros(0, bool)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return sorted_h[head], order[head], inverse


def _slices(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The bytes of spans, end to end."""
    n = e - s
    return data[np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())] if len(s) else data[:0]


def word_table(docs: DataFrame, tokenizer_path: str) -> tuple[H.HashArrays, str]:
    """Tokenise every distinct word of ``docs`` once and write the word -> ids arrays.  Runs jobs."""
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_ranges = max(1, math.ceil(total / RANGE_BYTES))
    folder = H.mounted_folder(docs.sparkSession, "pack-words")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, sizes, chars = np.zeros(0, U), [], [], []

        def send():
            if not keys:
                return
            k, n, c = np.concatenate(keys), np.concatenate(sizes), np.concatenate(chars)
            order = np.argsort(k)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            k, n, start = k[order], n[order], start[order]
            cut = np.concatenate([[0], np.searchsorted(k, H.edges(n_ranges)), [len(k)]])
            zip_ = zstandard.ZstdCompressor(level=1)
            some = [i for i in range(n_ranges) if cut[i + 1] > cut[i]]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array([H.pack(k[a:b], n[a:b]) for a, b in ((cut[i], cut[i + 1]) for i in some)], pa.binary()),
                                   pa.array([zip_.compress(_slices(c, start[a:b], start[a:b] + n[a:b]).tobytes()) for a, b in ((cut[i], cut[i + 1]) for i in some)], pa.binary())],
                                  names=["part", "keys", "chars"])

        for batch in batches:
            for c in range(0, len(batch), TEXTS):
                data, s, e, _, h = _read(batch.column(0).slice(c, TEXTS))
                own, at, _ = _distinct(h)
                new = ~np.isin(own, known, assume_unique=True)
                own, at = own[new], at[new]
                keys.append(own)
                sizes.append(e[at] - s[at])
                chars.append(_slices(data, s[at], e[at]))
                known = np.concatenate([known, own])
                if len(known) > 2_000_000:
                    yield from send()
                    known, keys, sizes, chars = np.zeros(0, U), [], [], []
        yield from send()

    def tokenise(t: pa.Table) -> pa.Table:
        k = t["part"][0].as_py()
        parts = [H.unpack(b.as_py()) for b in t["keys"]]
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b.as_py()) for b in t["chars"]), np.uint8)
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = n.astype(np.int64)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        own, at, _ = _distinct(keys)
        raw = data.tobytes()
        ids, length = [], np.zeros(len(own), np.int64)
        for c in range(0, len(at), 20_000):
            flat, length[c:c + 20_000] = encode_words([raw[start[i]:start[i] + n[i]].decode() for i in at[c:c + 20_000]], tokenizer_path)
            ids.append(flat)
        H.save(folder, f"words-{k}-keys", own)
        H.save(folder, f"words-{k}-check", words.hash_spans(data, start[at], start[at] + n[at], seed=1).astype(np.uint32))
        H.save(folder, f"words-{k}-first", np.concatenate([[0], np.cumsum(length)]))
        H.save(folder, f"words-{k}-ids", H.smallest(np.concatenate(ids)) if ids else np.zeros(0, np.uint16))
        return pa.table({"part": pa.array([k], pa.int32()), "n": [len(own)]})

    rows = docs.select("text").mapInArrow(collect, "part int, keys binary, chars binary").groupBy("part") \
        .applyInArrow(tokenise, "part int, n long").collect()  # one row per range
    sizes = [0] * n_ranges
    for r in rows:
        sizes[r.part] = r.n
    return H.HashArrays(folder, "words", sizes), folder


def _tokens_of(table: H.HashArrays, own: np.ndarray, texts, check: np.ndarray, tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words (in hash order), end to end, and the n + 1 places."""
    place = table.find(own)
    part = np.searchsorted(table.base, place, side="right") - 1
    sizes, pieces, strange = np.zeros(len(own), np.int64), [], []
    for k in np.unique(part):  # words are in hash order, so a range's words are neighbours
        here = np.flatnonzero(part == k)
        if place[here[0]] < 0:
            strange.extend(here)
            continue
        at = place[here] - table.base[k]
        load = lambda what: H.load(table.folder, f"words-{k}-{what}")  # noqa: B023, E731
        first = load("first")
        a, b = first[at], first[at + 1]
        sizes[here] = b - a
        pieces.append((here, _slices(load("ids"), a, b).astype(np.uint32)))
        strange.extend(here[load("check")[at] != check[here]])
    ids = {}
    if strange:  # unknown, or two words of one hash: such a word is tokenised on its own
        tokenizer = load_tokenizer(tokenizer_path)
        ids = {i: np.array(tokenizer.encode(texts(i), add_special_tokens=False).ids, np.uint32) for i in strange}
    found = sizes.copy()
    for i, x in ids.items():
        sizes[i] = len(x)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(first[-1], np.uint32)
    for here, flat in pieces:
        good = np.ones(len(here), bool) if not ids else ~np.isin(here, list(ids))
        flat = flat[np.repeat(good, found[here])]
        here = here[good]
        out[np.repeat(first[here] - np.concatenate([[0], np.cumsum(sizes[here])[:-1]]).astype(np.int64), sizes[here]) + np.arange(len(flat))] = flat
    for i, x in ids.items():
        out[first[i]:first[i + 1]] = x
    return out, first


def token_batches(table: H.HashArrays, tokenizer_path: str, batches: Iterator[pa.RecordBatch],
                  end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of every few hundred rows (key, text): the rows, their ids end to end with the end id behind each text, and the n + 1 places."""
    for batch in batches:
        for c in range(0, len(batch), TEXTS):
            part = batch.slice(c, TEXTS)
            data, s, e, first, h = _read(part.column(1))
            own, at, inverse = _distinct(h)
            check = words.hash_spans(data, s[at], e[at], seed=1).astype(np.uint32)
            ids, begin = _tokens_of(table, own, lambda i: data[s[at[i]]:e[at[i]]].tobytes().decode(), check, tokenizer_path)  # noqa: B023
            flat = _slices(ids, begin[inverse], begin[inverse + 1])
            per = np.concatenate([[0], np.cumsum(begin[inverse + 1] - begin[inverse])])[first]
            yield part, np.insert(flat, per[1:], end_id), per + np.arange(len(per))


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n, ids, row_no): ids as packed unsigned 32-bit little-endian numbers, end id included; landed."""
    docs = as_docs(docs, "doc_id", "text")
    table, _ = word_table(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for part, flat, per in token_batches(table, tokenizer_path, batches, END_ID):
            yield pa.record_batch([part.column(0), pa.array(np.diff(per)),
                                   pa.array([zip_.compress(H.planes(flat[a:b])) for a, b in zip(per[:-1], per[1:], strict=True)], pa.binary())],
                                  names=["doc_id", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(run, f"doc_id {kind}, n long, ids binary")
    return land(rows.withColumn("row_no", F.monotonically_increasing_id()), "pack-tokens")


def postings(terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, document, count) in that order, and the words of every document."""
    size = np.array([len(t) for t in terms], np.int64)
    doc = np.repeat(np.arange(len(terms)), size)
    flat = np.concatenate(terms) if terms else np.zeros(0, U)
    order = np.lexsort((doc, flat))
    flat, doc = flat[order], doc[order]
    head = np.concatenate([[True], (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])]) if len(flat) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    return flat[at], doc[at], np.diff(np.append(at, len(flat))), size


def bm25(df: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, mean: float) -> np.ndarray:
    return np.log1p((n_docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1)))


def word_starts(flat: np.ndarray) -> np.ndarray:
    """Where each word begins in sorted words, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])), len(flat)) if len(flat) else np.zeros(1, np.int64)


class Index:
    """BM25 inverted index: for every word its documents and their weights.

    Weights follow from the documents themselves unless (word, document, weight), sorted, are given
    as ``rows`` for ``n`` documents.
    """

    def __init__(self, terms: list[np.ndarray] | None, rows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, n: int = 0):
        if rows is None:
            flat, self.doc, tf, size = postings(terms)
            self.n, self.first = len(terms), word_starts(flat)
            df = np.repeat(np.diff(self.first), np.diff(self.first))
            self.weight = bm25(df, tf, size[self.doc], self.n, size.mean()) if len(flat) else np.zeros(0)
        else:
            flat, self.doc, self.weight = rows
            self.n, self.first = n, word_starts(flat)
        df = np.diff(self.first)
        number = np.repeat(np.arange(len(df)), df)
        # of each document the words that another document has, too
        shared = df[number] > 1
        own, num = self.doc[shared], number[shared]
        order = np.lexsort((num, own))
        own, self.query = own[order], num[order]
        self.query_first = np.searchsorted(own, np.arange(self.n + 1))

    def neighbours(self, doc: int) -> np.ndarray:
        """Documents by falling BM25 score for all the document's words."""
        q = self.query[self.query_first[doc]:self.query_first[doc + 1]]
        if not len(q):
            return q
        a, n = self.first[q], self.first[q + 1] - self.first[q]
        take = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        found, inverse = np.unique(self.doc[take], return_inverse=True)
        return found[np.lexsort((found, -np.bincount(inverse, self.weight[take])))]


def pack_shard(sizes: np.ndarray, index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard's documents."""
    used, pieces, seq, at = np.zeros(len(sizes), bool), [], 0, 0

    def put(doc: int, start: int) -> int:
        """Put what fits of a document from ``start``; where it goes on."""
        nonlocal seq, at
        n = min(int(sizes[doc]) - start, window - at)
        pieces.append((doc, start, n, seq, at))
        at += n
        if at == window:
            seq, at = seq + 1, 0
        return start + n

    rest: tuple[int, int] | None = None
    fresh = 0
    while True:
        if rest is None:
            while fresh < len(sizes) and used[fresh]:
                fresh += 1
            if fresh == len(sizes):
                break
            used[fresh], rest = True, (fresh, 0)
        doc, start = rest
        rest, began = None, seq
        start = put(doc, start)
        while start < sizes[doc]:  # a document longer than the window fills the next ones
            began = seq
            start = put(doc, start)
        if at == 0:
            continue
        for other in index.neighbours(doc):
            if used[other]:
                continue
            used[other] = True
            stop = put(int(other), 0)
            if seq != began:
                rest = (int(other), stop) if stop < sizes[other] else None
                break
    if at:  # the last sequence: lengths that are powers of two need no padding
        tail = [p for p in pieces if p[3] == seq]
        pieces = pieces[:len(pieces) - len(tail)]
        bounds, done = [], 0
        for bit in reversed(range(at.bit_length())):
            if at >> bit & 1:
                bounds.append((done, done + (1 << bit)))
                done += 1 << bit
        for doc, start, n, _, off in tail:
            for k, (a, b) in enumerate(bounds):
                lo, hi = max(off, a), min(off + n, b)
                if lo < hi:
                    pieces.append((doc, start + lo - off, hi - lo, seq + k, lo - a))
    return pieces


def _ids(blob: bytes, unzip: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzip.decompress(blob), np.uint8).reshape(8, -1)[:4].T).view("<u4").reshape(-1)


def document_counts(rows: DataFrame, n_tokens: int, tokenizer_path: str) -> tuple[H.HashArrays, int]:
    """How many documents have each word that two have, as arrays, and the number of words of all.  Runs a job."""
    n_ranges = max(1, math.ceil(n_tokens / RANGE_BYTES))
    folder = H.mounted_folder(rows.sparkSession, "pack-counts")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, unzip, counter, total = word_ends(tokenizer_path), zstandard.ZstdDecompressor(), H.Counter(n_ranges, most=2_000_000), 0
        for batch in batches:
            for c in range(0, len(batch), TEXTS):
                terms = [_terms(_ids(x.as_py(), unzip), ends) for x in batch.column(0).slice(c, TEXTS)]
                total += sum(len(t) for t in terms)
                yield from counter.add(np.concatenate([np.unique(t) for t in terms]))
        yield from counter.flush()
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([H.pack(np.zeros(1, U), np.array([total]))], pa.binary())], names=["part", "blob"])

    def merge(t: pa.Table) -> pa.Table:
        k = t["part"][0].as_py()
        keys, n = H.merge(b.as_py() for b in t["blob"])
        if k < 0:
            return pa.table({"part": pa.array([k], pa.int32()), "n": [int(n.sum())]})
        keys, n = keys[n > 1], n[n > 1]
        H.save(folder, f"df-{k}-keys", keys)
        H.save(folder, f"df-{k}-n", H.smallest(n))
        return pa.table({"part": pa.array([k], pa.int32()), "n": [len(keys)]})

    sizes, total = [0] * n_ranges, 0
    for r in rows.select("ids").mapInArrow(collect, "part int, blob binary").groupBy("part").applyInArrow(merge, "part int, n long").collect():
        if r.part < 0:
            total = r.n
        else:
            sizes[r.part] = r.n
    return H.HashArrays(folder, "df", sizes), total


class Corpus:
    """The BM25 index of all documents in blocks of files; documents are numbered through the blocks."""

    def __init__(self, rows: DataFrame, tokenizer_path: str):
        """Runs jobs."""
        n_docs, n_tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts, total = document_counts(rows, n_tokens, tokenizer_path)
        self.folder = folder = H.mounted_folder(rows.sparkSession, "pack-index")
        self.spark = rows.sparkSession
        mean, most, most_docs = total / max(n_docs, 1), SHARDS * SHARD_TOKENS, SHARD_DOCS

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends, unzip, task = word_ends(tokenizer_path), zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
            row, size, terms, done, held = [], [], [], 0, 0

            def save():
                flat, doc, tf, length = postings(terms)
                first = word_starts(flat)
                df = counts.take(counts.find(flat[first[:-1]]), "n")
                keep = np.repeat(df > 1, np.diff(first))  # a word that one document has leads to no other
                weight = bm25(np.repeat(df, np.diff(first)), tf, length[doc], n_docs, mean)[keep]
                _save_block(folder, f"{task}-{done}", flat[keep], doc[keep], weight)
                H.save(folder, f"{task}-{done}-row", np.array(row))
                H.save(folder, f"{task}-{done}-size", np.array(size))
                return pa.record_batch([pa.array([f"{task}-{done}"]), pa.array([len(row)], pa.int64())], names=["block", "n"])

            for batch in batches:
                for no, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if row and (held + n > most or len(row) == most_docs):
                        yield save()
                        row, size, terms, done, held = [], [], [], done + 1, 0
                    row.append(no)
                    size.append(n)
                    terms.append(_terms(_ids(blob.as_py(), unzip), ends))
                    held += n
            if row:
                yield save()

        made = sorted((r.block, r.n) for r in rows.select("row_no", "n", "ids").mapInArrow(build, "block string, n long").collect())  # one row per block
        self.blocks = [b for b, _ in made]
        self.base = np.concatenate([[0], np.cumsum([n for _, n in made])]).astype(np.int64)
        every = lambda what: np.concatenate([np.zeros(0, np.int64), *[np.load(f"{folder}/{b}-{what}.npy") for b in self.blocks]])
        self.row, self.size = every("row"), every("size")
        self.age, self.cut, self.no = 0, self.base, np.arange(self.base[-1])  # which documents the blocks hold, as some are left out later on
        H.save(folder, "numbers-0", self.no)

    def _files(self):
        """What tasks need of this: no session, no arrays."""
        folder, blocks, cut, numbers = self.folder, self.blocks, self.cut, f"numbers-{self.age}"

        def block(b: int) -> list[np.ndarray]:
            return [_open(folder, f"{blocks[b]}-{what}") for what in ("term", "first", "doc", "weight")]

        def numbers_of(b: int) -> np.ndarray:
            return H.load(folder, numbers)[cut[b]:cut[b + 1]]

        def terms_of(docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(word, place in ``docs``, weight) of documents in rising order, block by block."""
            for b in range(len(blocks)):
                no = numbers_of(b)
                lo, hi = np.searchsorted(docs, no[0]), np.searchsorted(docs, no[-1], side="right")
                if lo < hi:
                    term, first, doc, weight = block(b)
                    place = np.full(len(no), -1, np.int32)
                    place[np.searchsorted(no, docs[lo:hi])] = np.arange(lo, hi)
                    at = place[doc]
                    has = np.flatnonzero(at >= 0)
                    yield term[np.searchsorted(first, has, side="right") - 1], at[has].astype(np.int64), weight[has]

        return block, numbers_of, terms_of

    def forget(self, free: np.ndarray) -> None:
        """Write the blocks anew without the documents that aren't free, several small ones as one.  Runs a job.

        Document frequencies and weights stay those of the whole corpus.
        """
        block, numbers_of, _ = self._files()
        folder, age, left = self.folder, self.age + 1, free[self.no]
        n, tokens = (np.add.reduceat(x, self.cut[:-1]) for x in (left.astype(np.int64), np.where(left, self.size[self.no], 0)))
        groups: list[list[int]] = []
        docs = held = 0
        for b in np.flatnonzero(n).tolist():
            if not groups or docs + n[b] > SHARD_DOCS or held + tokens[b] > SHARDS * SHARD_TOKENS:
                groups.append([])
                docs = held = 0
            groups[-1].append(b)
            docs, held = docs + n[b], held + tokens[b]
        H.save(folder, f"left-{age}", free)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in (int(i) for batch in batches for i in batch.column(0).to_numpy()):
                free, parts, docs = H.load(folder, f"left-{age}"), [], 0
                for b in groups[g]:
                    keep = free[numbers_of(b)]
                    term, first, doc, weight = block(b)
                    has = np.flatnonzero(keep[doc])
                    parts.append((np.repeat(term, np.diff(first.astype(np.int64)))[has], (np.cumsum(keep) - 1)[doc[has]] + docs, weight[has]))
                    docs += int(keep.sum())
                flat, doc, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
                if len(parts) > 1:
                    order = np.argsort(flat, kind="stable")
                    flat, doc, weight = flat[order], doc[order], weight[order]
                _save_block(folder, f"{age}.{g}", flat, doc, weight)
                yield pa.record_batch([pa.array([docs], pa.int64())], names=["n"])

        self.spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(run, "n long").collect()  # one row per block
        old = [f"{b}-{what}" for b in self.blocks for what in ("term", "first", "doc", "weight")] + [f"left-{age}", f"numbers-{self.age}"]
        self.no, self.cut = self.no[left], np.concatenate([[0], np.cumsum([sum(n[b] for b in g) for g in groups])]).astype(np.int64)
        self.blocks, self.age = [f"{age}.{g}" for g in range(len(groups))], age
        H.save(folder, f"numbers-{age}", self.no)
        for name in old:
            os.remove(f"{folder}/{name}.npy")

    def neighbours(self, seeds: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, document, score) of the ``k`` free documents of greatest score of every seed, seed by seed by falling score.

        The scores are those of all the seed's words over the whole corpus; seeds don't find
        themselves, nor documents of score 0.  Equal scores are put in an order of the seed's own (by
        a hash, as one part in a million), so that seeds among many copies ask for different ones.
        """
        block, numbers_of, terms_of = self._files()
        folder, n_blocks, width, name = self.folder, len(self.blocks), SEED_BLOCK, os.urandom(6).hex()
        H.save(folder, f"seeds-{name}", np.sort(seeds))
        H.save(folder, f"free-{name}", free)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for task in (int(i) for batch in batches for i in batch.column(0).to_numpy()):
                own = np.array(H.load(folder, f"seeds-{name}")[task * width:(task + 1) * width])
                word, seed, _ = (np.concatenate(x) for x in zip((np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0)), *terms_of(own), strict=True))
                order = np.argsort(seed, kind="stable")
                seed = seed[order]
                word, inverse = np.unique(word[order], return_inverse=True)
                best = Best(len(own), k)
                for b in range(n_blocks):
                    no = numbers_of(b)
                    ok = H.load(folder, f"free-{name}")[no]
                    if not ok.any():
                        continue
                    scores = _scores(*block(b), len(no), word, inverse, seed, len(own))
                    scores[:, ~ok] = 0
                    at = np.minimum(np.searchsorted(no, own), len(no) - 1)
                    inside = np.flatnonzero(no[at] == own)
                    scores[inside, at[inside]] = 0
                    i, j = np.nonzero(scores > best.least[:, None])
                    mark = words.mix(own[i].astype(U)).astype(np.uint32) ^ words.mix(no[j].astype(U) + U(1)).astype(np.uint32)
                    best.add(i, no[j], scores[i, j] * (1 + 1e-6 * ((mark * np.uint32(2654435761)) >> np.uint32(16)).astype(np.float32) / 65536))
                i, doc, score = best.get()
                yield pa.record_batch([pa.array(own[i]), pa.array(doc), pa.array(score)], names=["seed", "doc", "score"])

        n = max(1, math.ceil(len(seeds) / width))
        got = self.spark.range(0, n, 1, n).mapInArrow(run, "seed long, doc long, score float").toArrow()  # at most SEEDS x ASKED rows unless no window fills
        for what in ("seeds", "free"):
            os.remove(f"{folder}/{what}-{name}.npy")
        return got["seed"].to_numpy(), got["doc"].to_numpy(), got["score"].to_numpy()

    def rest(self, docs: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
        """Pieces of ``pack_shard`` for these documents (in rising order) as an array of five columns.  Runs a job."""
        _, _, terms_of = self._files()
        folder, name = self.folder, os.urandom(6).hex()
        H.save(folder, f"rest-{name}", np.stack([docs, sizes]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                own, size = np.array(H.load(folder, f"rest-{name}"))
                rows = [np.concatenate(x) for x in zip((np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.float32)), *terms_of(own), strict=True)]
                order = np.lexsort((rows[1], rows[0]))
                pieces = pack_shard(size, Index(None, tuple(x[order] for x in rows), len(own)), window)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*pieces, strict=True)], names=["doc", "start", "n", "seq", "off"])

        got = self.spark.range(0, 1, 1, 1).mapInArrow(run, "doc long, start long, n long, seq long, off long").toArrow()
        return np.stack([c.to_numpy() for c in got.columns], axis=1)


def _save_block(folder: str, name: str, flat: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
    """Postings in the order of their words as files."""
    first = word_starts(flat)
    for what, x in (("term", flat[first[:-1]]), ("first", first.astype(np.uint32)), ("doc", doc.astype(np.uint16)), ("weight", weight.astype(np.float32))):
        H.save(folder, f"{name}-{what}", x)


def _open(folder: str, name: str) -> np.ndarray:
    """A memory map that lives as long as it is used: blocks are written anew as the work goes on."""
    path = f"{folder}/{name}.npy"
    return np.load(path, mmap_mode="r" if os.path.getsize(path) > 256 else None)


class Best:
    """The ``k`` greatest scores above 0 of each of ``n`` seeds, of documents that come in any order.

    Nothing that isn't above a seed's ``least`` needs to be added.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.held = n, k, 0
        self.least = np.zeros(n, np.float32)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, seed: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """``score`` as float32 above 0, whose bits are in the order of the numbers."""
        key = (seed.astype(U) << U(32)) | (U(0xFFFFFFFF) - score.view(np.uint32).astype(U))
        self.parts.append((key, doc))
        self.held += len(key)
        if self.held > 2 * self.n * self.k:
            self._drop(np.argsort)

    def _drop(self, sort) -> None:
        key, doc = (np.concatenate(x) for x in zip((np.zeros(0, U), np.zeros(0, np.int64)), *self.parts, strict=True))
        order = sort(key) if sort is np.argsort else np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        seed = (key >> U(32)).astype(np.int64)
        first = np.searchsorted(seed, np.arange(self.n + 1))
        keep = np.arange(len(key)) - first[seed] < self.k
        full = np.flatnonzero(np.diff(first) >= self.k)
        # a score gains up to one part in a million after the comparison
        self.least[full] = self._score(key[first[full] + self.k - 1]) * np.float32(1 - 3e-6)
        self.parts, self.held = [(key[keep], doc[keep])], int(keep.sum())

    @staticmethod
    def _score(key: np.ndarray) -> np.ndarray:
        return (U(0xFFFFFFFF) - (key & U(0xFFFFFFFF))).astype(np.uint32).view(np.float32)

    def get(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, document, score), seed by seed by falling score; equal scores by document."""
        self._drop(np.lexsort)
        key, doc = self.parts[0]
        return (key >> U(32)).astype(np.int64), doc, self._score(key)


CLAIMS = 16  # ranks after which seeds that are full are left out
DENSE = 12  # a word that one in so many documents of a block has is scored by a matrix product


def _scores(term, first, doc, weight, n: int, word: np.ndarray, inverse: np.ndarray, seed: np.ndarray, n_seeds: int) -> np.ndarray:
    """Scores of a block's documents for seeds, whose words are ``word[inverse]``; ``seed`` is in rising order."""
    out = np.zeros((n_seeds, n), np.float32)
    if not len(term) or not len(word):
        return out
    term, first, doc, weight = np.asarray(term), first.astype(np.int64), doc.astype(np.int64), weight.astype(np.float64)
    at = np.minimum(np.searchsorted(term, word), len(term) - 1)
    at = np.where(term[at] == word, at, -1)[inverse]
    known = at >= 0
    seed, at = seed[known], at[known]
    df = np.diff(first)
    m = df[at]
    common = m * DENSE > n
    some, place = np.unique(at[common], return_inverse=True)
    if len(some):
        asks, has = np.zeros((n_seeds, len(some)), np.float32), np.zeros((len(some), n), np.float32)
        asks[seed[common], place] = 1
        take = np.repeat(first[some] - (np.cumsum(df[some]) - df[some]), df[some]) + np.arange(df[some].sum())
        has[np.repeat(np.arange(len(some)), df[some]), doc[take]] = weight[take]
        np.matmul(asks, has, out=out)
    seed, at, m = seed[~common], at[~common], m[~common]
    until = np.concatenate([[0], np.cumsum(m)])
    begin = np.searchsorted(seed, np.arange(n_seeds + 1))  # of each seed's words
    every, shift = np.arange(np.diff(until[begin]).max(initial=0)), first[at] - until[:-1]
    for i, (s, e) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        if s < e:  # a seed's postings at a time stay in the processor's cache
            take = np.repeat(shift[s:e] + until[s], m[s:e])
            take += every[:len(take)]
            out[i] += np.bincount(doc.take(take), weight.take(take), minlength=n)
    return out


def pack_corpus(corpus: Corpus, window: int = WINDOW) -> np.ndarray:
    """(document, start, length, sequence, offset) of every piece of all documents, as five columns.  Runs jobs."""
    size, start = corpus.size.copy(), np.zeros(len(corpus.size), np.int64)
    order = np.argsort(words.mix(np.arange(len(size)).astype(U)), kind="stable")  # of seeds: spread over the corpus
    pieces, seq = [np.zeros((0, 5), np.int64)], 0
    whole = size // window  # windows that a long document fills by itself
    if whole.sum():
        doc = np.repeat(np.arange(len(size)), whole)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        pieces.append(np.stack([doc, k * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)], axis=1))
        seq, start, size = len(doc), whole * window, size % window
    asked, most = ASKED, SEEDS
    while size.sum() > max(SHARD_TOKENS, window):
        pool = order[size[order] > 0]
        pool = pool[np.argsort(start[pool] == 0, kind="stable")]  # what is left of cut documents first
        seeds = pool[:max(1, min(most, int(size.sum()) // (2 * window)))]
        free = size > 0
        if free.sum() * 5 < len(corpus.no) * 4:
            corpus.forget(free)
        seed, doc, score = corpus.neighbours(seeds, free, asked)
        by = np.argsort(seed, kind="stable")
        seed, doc, score = seed[by], doc[by], score[by]
        members = {int(s): [] for s in seeds}
        some, first, count = np.unique(seed, return_index=True, return_counts=True)
        number = dict(zip(some.tolist(), count.tolist(), strict=True))
        room, taken = {s: window - int(size[s]) for s in members}, set()
        for c in range(0, asked, CLAIMS):
            wants = np.flatnonzero([count[i] > c and room[s] > 0 and s not in taken for i, s in enumerate(some.tolist())])
            if not len(wants):
                break
            n = np.minimum(count[wants] - c, CLAIMS)
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(first[wants] + c, n) + rank
            at = at[np.lexsort((seed[at], -score[at], rank))]
            for s, d in zip(seed[at].tolist(), doc[at].tolist(), strict=True):
                if room[s] > 0 and s not in taken and d not in taken and not members.get(d):
                    members[s].append(d)
                    taken.add(d)
                    room[s] -= int(size[d])
        full = [s for s in members if s not in taken and room[s] <= 0]
        gone = set(full).union(*(members[s] for s in full))
        spare = iter(pool.tolist())
        for s in members:  # no more related documents at all: any others
            if s in gone or room[s] <= 0 or number.get(s, 0) >= asked:
                continue
            mine = [d for d in members[s] if d not in gone] if s not in taken else []
            own, left = {s, *mine}, window - int(size[s]) - sum(int(size[d]) for d in mine)
            for d in spare if left > 0 else ():
                if d not in gone and d not in own and d not in members:
                    mine.append(d)
                    left -= int(size[d])
                    if left <= 0:
                        break
            if left <= 0:
                members[s] = mine
                full.append(s)
                gone.update(own, mine)
        made = []
        for s in full:
            at = 0
            for d in (s, *members[s]):
                n = min(int(size[d]), window - at)
                made.append((d, int(start[d]), n, seq, at))
                at, start[d], size[d] = at + n, start[d] + n, size[d] - n
            seq += 1
        if made:
            pieces.append(np.array(made, np.int64))
            asked, most = ASKED, min(SEEDS, 2 * most)
        else:
            asked, most = min(4 * asked, len(size) + 1), max(1, len(seeds) // 4)
    left = np.flatnonzero(size > 0)
    if len(left):
        last = corpus.rest(left, size[left], window)
        last[:, 0] = left[last[:, 0]]
        last[:, 1] += start[last[:, 0]]
        last[:, 3] += seq
        pieces.append(last)
    return np.concatenate(pieces)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row per piece.

    ``ids`` are the piece's token ids (unsigned 32-bit little-endian); ``ids_crc32`` their checksum.
    Every document's ids, its end id included, lie in exactly one piece each.  Null, empty and white
    texts are one end id.  Null and repeated doc_ids are packed row by row.  An empty table gives
    no row.  Runs jobs when called.
    """
    rows = tokenised(docs, tokenizer_path)
    corpus = Corpus(rows, tokenizer_path)
    pieces = pack_corpus(corpus, window)
    row = corpus.row[pieces[:, 0]]
    order = np.lexsort((pieces[:, 1], row))
    folder = H.mounted_folder(docs.sparkSession, "pack-pieces")
    H.save(folder, "row", row[order])
    H.save(folder, "piece", pieces[order, 1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, rows_of, piece = zstandard.ZstdDecompressor(), H.load(folder, "row"), H.load(folder, "piece")
        for batch in batches:
            for c in range(0, len(batch), PIECES):
                part = batch.slice(c, PIECES)
                no = part.column(1).to_numpy()
                a = np.searchsorted(rows_of, no)
                n = np.searchsorted(rows_of, no, side="right") - a
                doc = np.repeat(np.arange(len(no)), n)
                start, length, seq, off = piece[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())].T
                ids = [_ids(x.as_py(), unzip) for x in part.column(3)]
                blobs = [ids[d][s:s + k].tobytes() for d, s, k in zip(doc, start, length, strict=True)]
                yield pa.record_batch([part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                                       part.column(2).take(pa.array(doc)), pa.array(seq), pa.array(off), pa.array(blobs, pa.binary())],
                                      names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row_no", "n", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _terms(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of a document's words, each a run of ids up to one that ends a word (the end id left out)."""
    ids = ids[:-1]
    if not len(ids):
        return np.zeros(0, U)
    stop = ends[ids]
    stop[-1] = True
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    h = words.mix(ids.astype(U) + U(1))
    place = np.arange(len(ids)) - np.repeat(first, last - first + 1)
    return words.mix(np.add.reduceat(h * words.mix(place.astype(U) + U(7)), first))
