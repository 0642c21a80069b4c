"""The prefix trie against brute force."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelbench.llm import trie
from labelbench.session import land
from tests.conftest import SF_SMALL

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string, block string, seq string, depth string"


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def table(spark, rows):
    return land(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3), "turns")


def check(spark, monkeypatch, rows, blocks=(16_384, 7, 1), **kw):
    t = table(spark, rows)
    want = brute.trie(rows, kw.get("plain"))
    for block in blocks:
        monkeypatch.setattr(trie, "BLOCK", block)
        assert rows_of(trie.prefix_trie(t, *([kw["shared"]] if "shared" in kw else []))) == want


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, monkeypatch, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL.replace('0.001', sf)}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, monkeypatch, rows, (16_384, 9))


def test_odd_rows(spark, monkeypatch):
    rows = [(None, 0, "user", "no conversation"), (0, None, "user", "null turn"), (0, 0, None, None), (0, 0, "user", "tie"), (0, 0, "user", "tie"),
            (0, 9, "assistant", "end \U0001F600"), (7, 0, "user", ""), (-7, 1, "user", "below"), (-150, 1, "", "x" * 50_000), (100, 5, "user", None),
            (101, 5, "user", "a"), (102, 5, "user", "a"), (103, 1, "user", "b"), (103, 2, "user", "c"), (250, 1, "user", "no base"), (251, 1, "user", "no base")]
    check(spark, monkeypatch, rows)
    assert trie.prefix_trie(table(spark, rows).filter("conv_id = 1")).count() == 0
    check(spark, monkeypatch, [(3, 0, "user", "only one")])


def test_hot_groups(spark, monkeypatch):
    """A third are copies of one conversation, a third share their first turn; one conversation is very long."""
    random.seed(1)
    rows = [(c, k, "user", f"copy {k}") for c in range(60) for k in range(3)]
    rows += [(c, k, "user", "the same" if k == 0 else random.choice("ab")) for c in range(60, 120) for k in range(4)]
    rows += [(c, k, "user", random.choice("abc")) for c in range(120, 170) for k in range(random.randint(1, 5))]
    rows += [(500, k, "user", f"turn {k}") for k in range(200)] + [(501, k, "user", f"turn {k}") for k in range(190)]
    check(spark, monkeypatch, rows, (16_384, 11), shared=lambda c: F.lit(0), plain=lambda c: 0)
    monkeypatch.setattr(trie, "BLOCK_TURNS", 150)
    check(spark, monkeypatch, rows, (4,))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 4), max_size=40), st.data())
def test_searches_equal_a_walk(x, data):
    lcp = np.array(x, np.int64)
    table = trie.RangeMin(lcp)
    i, d = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, 5))
    left = right = i
    while left and x[left - 1] >= d:
        left -= 1
    while right < len(x) and x[right] >= d:
        right += 1
    assert table.first(np.array([i]), np.array([d])).tolist() == [left]
    assert table.last(np.array([i]), np.array([d])).tolist() == [right]
    if right > left:
        assert table.over(np.array([left]), np.array([right])).tolist() == [min(x[left:right])]
