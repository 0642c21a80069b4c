"""Alignment of two tokenizers against brute force over the tokenizers themselves."""
import numpy as np
import pytest

from labelbench.llm import align, queries
from labelbench.llm.packing import load_tokenizer
from labelbench.session import land
from tests.conftest import SF_SMALL

from . import brute


def plain(texts):
    path_a, path_b = queries.aligned_paths()
    a, b = load_tokenizer(path_a), align.load_pieces(path_b)
    a.encode_special_tokens = True
    byte_of, k = {}, 0
    for x in range(256):
        if chr(x).isprintable() and x != 32 and x != 0xAD and (x < 127 or x > 160):
            byte_of[chr(x)] = x
        else:
            byte_of[chr(256 + k)] = x
            k += 1
    bytes_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return brute.alignment(texts, lambda t: a.encode(t, add_special_tokens=False).ids, bytes_a, b.encode, bytes_b)


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, *[r[c] for c in align.MEASURES], r.groups_sha256) for r in df.collect())


def check(df, docs):
    got = plain([t for _, t in docs])
    assert rows_of(df) == sorted((i is None, i or 0, *m) for (i, _), m in zip(docs, got, strict=True))


@pytest.mark.parametrize("texts", [512, 7])
def test_short_texts_of_a_whole_table(spark, monkeypatch, texts):
    """All documents, their lines as documents of their own: many repeat, and brute force compares all tokens of a text."""
    lines = [x for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect() for x in (r.text or "").split("\n")]
    docs = list(enumerate(lines))
    monkeypatch.setattr(align, "RUN", 50)
    monkeypatch.setattr(align, "TEXTS", texts)
    table = land(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "lines")
    check(align.token_alignment(table, *queries.aligned_paths())[0], docs)


def test_odd_rows(spark):
    texts = [None, "", " ", "\n\t ", "plain words here", "plain words here", "plain words here", "  two  spaces ", "<s>special</s> <|endoftext|> <unk> <0x41>",
             "a▁b is not given back", "Ünḯcödé \U0001F600\U0001F468‍\U0001F469 漢字 \x00\x07", "x" * 5000, "word " * 20_000, "\r\nline\r\n", "fiﬁ  　"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "plain words here"), (None, None), (4, "plain words here")]
    short = [(i, t) for i, t in docs if not t or len(t) < 90_000]
    table = land(spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, key string, n int").repartition(2), "odd")
    out, counts = align.token_alignment(table.filter("text is null or length(text) < 90000"), *queries.aligned_paths())
    check(out, short)
    assert counts.groupBy("code").count().filter("count > 1").count() == 0
    long = align.token_alignment(table, *queries.aligned_paths())[0].filter("doc_id = 12").first()
    assert long.n_a >= 20_000 and long.n_links >= long.n_a and long.n_groups > 19_000
    assert align.token_alignment(table.filter("doc_id < 0"), *queries.aligned_paths())[0].collect() == []


def test_hot_text_is_aligned_once(spark):
    docs = [(k, "the same text in a third of all rows" if k % 3 == 0 else f"text number {k % 40}") for k in range(900)]
    table = land(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "hot")
    out, counts = align.token_alignment(table, *queries.aligned_paths())
    check(out, docs)
    blocks = align.aligned_texts(table, *queries.aligned_paths())
    assert sum(len(r.key) for r in blocks.collect()) == len({t for _, t in docs})
    assert counts.agg({"count": "sum"}).first()[0] == out.agg({"n_links": "sum"}).first()[0]


def test_numbers_shrink_and_grow():
    for x in (np.zeros(0, np.int64), np.array([5, 70_000, 2**32 - 1, 0])):
        assert align._grow(align._shrink(x)).tolist() == x.tolist()
