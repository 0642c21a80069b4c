"""Hierarchical best-fit packing: tokens and cuts against the tokenizer, places against the rules of a packing."""
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import bestfit, queries
from labelbench.llm.packing import load_tokenizer
from labelbench.session import land
from tests.conftest import SF_SMALL


def check_places(rows, window):
    """Sequences without gaps or overlaps; how many there are."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(seqs)


def check_tokens(rows, texts, window=4096, end_id=1):
    """Every document's pieces, in order, are the tokenizer's ids and the end id, cut at full windows only."""
    tokenizer = load_tokenizer(queries.tokenizer_path())
    want = sorted(tuple((k, a, zlib.crc32(x.tobytes())) for k, (a, x) in enumerate((a, ids[a:a + window]) for a in range(0, len(ids), window)))
                  + (i is None, i or 0)
                  for i, t in texts for ids in [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4")])
    assert sum(len(w) - 2 for w in want) == len(rows)
    flat = sorted((i_null, i, *p) for *ps, i_null, i in want for p in ps)
    assert flat == sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.ids_crc32) for r in rows)
    for r in rows:
        ids = bestfit.read_ids(r.ids)
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32


@pytest.mark.parametrize("block", [16_384, 40, 3])
def test_whole_table(spark, block):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = bestfit.pack(docs, queries.tokenizer_path(), block=block).collect()
    check_tokens(rows, [(r.doc_id, r.text) for r in docs.collect()])
    least = -(-sum(r.length for r in rows) // 4096)
    assert check_places(rows, 4096) <= least + (0 if block > len(rows) else len(rows) // block // 10 + 1)


def test_odd_rows(spark):
    odd = [(1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (None, "null id", "a"), (None, "null id", "a"), (4, "same row", "a"), (4, "same row", "a"),
           (5, "word " * 30_000, "a"), (6, "x" * 9_000, "a"), (7, "<|endoftext|> É <|startoftext|>", "a"), (8, "tie one", "a"), (9, "tie two", "a")]
    docs = land(spark.createDataFrame(odd, "doc_id long, text string, bin string").repartition(3), "odd")
    for block in (100, 2):
        rows = bestfit.pack(docs, queries.tokenizer_path(), block=block).collect()
        check_tokens(rows, [(i, t) for i, t, _ in odd])
        check_places(rows, 4096)
    assert bestfit.pack(docs.filter("doc_id < 0"), queries.tokenizer_path()).collect() == []


@pytest.mark.parametrize("sizes", ["2500 if k % 3 else 900", "4096", "1", "2049 - k % 2", "1 + k * 37 % 4096"])
def test_a_third_of_one_size_over_many_groups(spark, sizes):
    """Rounds over many groups, whatever the sizes: no group beyond its bound, and close to one global best fit."""
    items = land(spark.range(9_000).selectExpr("id AS item").rdd.map(lambda r: (r.item, eval(sizes, {"k": r.item}))).toDF("item long, size long"), "items")
    for block, loss in ((25, 1.1), (500, 1.03)):  # bins of a few items each can't be as well filled as those of many
        at = bestfit.place(items, block=block).join(items, "item").collect()
        assert len(at) == 9_000
        bins = check_places([type("R", (), {"sequence_id": r.bin, "offset": r.offset, "length": r.size}) for r in at], 4096)
        assert bins <= loss * len(bestfit.best_fit(np.array([r.size for r in at]), 4096)[2]) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_equals_a_plain_search(sizes):
    x = np.array(sizes, np.int64)
    bins, offsets, fills = bestfit.best_fit(x, 64)
    plain = []
    for i in np.argsort(-x, kind="stable"):
        fits = [b for b, f in enumerate(plain) if f + x[i] <= 64]
        b = max(fits, key=lambda b: plain[b], default=len(plain))
        if b == len(plain):
            plain.append(0)
        plain[b] += x[i]
    assert sorted(plain) == sorted(fills.tolist())
    assert all(f == x[bins == b].sum() for b, f in enumerate(fills))
    assert sum(f <= 32 for f in fills) <= 1


def test_what_a_group_hands_on_is_bounded():
    fills = np.array([4000, 2500, 2049, 2048, 4090] + [2600] * 100)
    some = fills[bestfit.handed_on(fills, 4096)].tolist()
    assert some[:3] == [2048, 2049, 2500] and len(some) == bestfit.FAN + 1 and 4090 not in some
