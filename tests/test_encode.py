"""Encoding against a plain double: truncation, unknown words, null texts, blocks, pieces of words."""
import pytest

from labelbench.operators import encode as en
from labelbench.session import land

TEXTS = ["alpha beta alpha", "", None, "beta " * 20, "gamma!", "x" * 120 + " alpha", "alphabeta betagamma zeta", "été ALPHA \U0001F600"]


def plain(text, ids_of, max_len):
    words = [] if not text else [w for w in split(text)]
    ids = [i for w in words for i in ids_of(w)][:max_len - 2]
    pad = max_len - 2 - len(ids)
    return [en.CLS, *ids, en.SEP, *[en.PAD] * pad], [1] * (len(ids) + 2) + [0] * pad


def split(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
            continue
        out += [word] if word else []
        out += [] if c.isspace() else [c]
        word = ""
    return out


def greedy(word, pieces):
    out, at = [], 0
    while at < len(word):
        ends = [e for e in range(at + 1, len(word) + 1) if (word[at:e], at > 0) in pieces]
        if not ends or len(word) > 100:
            return [en.UNK]
        out.append(pieces[word[at:ends[-1]], at > 0])
        at = ends[-1]
    return out


@pytest.mark.parametrize("block", [512, 2])
@pytest.mark.parametrize("max_len", [8, 40])
def test_encoders_equal_plain_python(spark, monkeypatch, block, max_len):
    monkeypatch.setattr(en, "BLOCK", block)
    df = land(spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, description string").repartition(3), "texts")
    toks = en.tokenised(df)
    vocab = land(en.build_vocab(toks), "vocab")
    known = {r.token: r.token_id for r in vocab.collect() if r.token != "gamma"}
    got = {r.row_id: r for r in en.encode_tokens(toks, vocab.filter("token <> 'gamma'"), max_len).collect()}
    for i, t in enumerate(TEXTS):
        ids, mask = plain(t, lambda w: [known.get(w, en.UNK)], max_len)
        assert (got[i].input_ids, got[i].attention_mask, got[i].token_type_ids) == (ids, mask, [0] * max_len)
        assert got[i].n_tokens == (None if t is None else len(split(t)))
    for size in (1000, 24):
        rows = en.build_pieces(vocab, size).collect()
        assert len(rows) <= size and sorted(r.piece_id for r in rows) == list(range(4, 4 + len(rows)))
        pieces = {(r.piece, r.inside): r.piece_id for r in rows}
        got = {r.row_id: r for r in en.encode_subwords(toks, vocab, en.build_pieces(vocab, size), max_len).collect()}
        for i, t in enumerate(TEXTS):
            assert (got[i].input_ids, got[i].attention_mask) == plain(t, lambda w: greedy(w, pieces), max_len)  # noqa: B023
    assert any(en.UNK in r.input_ids for r in got.values())


def test_a_token_of_every_text_is_one_row_per_block(spark):
    df = spark.range(9_000).selectExpr("id AS row_id", "concat('the same ', id % 10) AS description").coalesce(1)
    toks = en.tokenised(df)
    plan = en.encode_tokens(toks, en.build_vocab(toks))._jdf.queryExecution().executedPlan().toString()
    asked = toks.selectExpr("block", "explode(tokens) AS token").distinct().filter("token = 'same'").count()
    assert asked == toks.select("block").distinct().count() == 18 and "FlatMapCoGroupsInArrow" in plan
    assert en.encode_tokens(toks.filter("row_id < 0"), en.build_vocab(toks)).count() == 0
