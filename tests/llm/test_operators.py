"""The operators against brute force, on odd rows and on empty tables."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelbench.llm import chat, embdedup, lm, mixing, packing, quality, queries, rules, sharding, simhash, substring, words
from labelbench.session import land
from tests.conftest import SF_SMALL

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, score string, fp string, key string, bucket string, text_ string"
PASSAGE = " ".join(f"common{k}" for k in range(60))
ODD = [(0, "alpha beta gamma " * 40 + "end.", "s0"), (1, None, "s0"), (2, "", None), (3, " \t\n\x0b ", "s1"), (4, "one", "s1"), (5, "one two", None),
       (6, PASSAGE + " tail six.", "s0"), (7, "head seven " + PASSAGE, "s0"), (8, PASSAGE.upper(), "s2"), (None, PASSAGE, None), (None, None, "s1"),
       (9, "dup row text here", "s1"), (9, "dup row text here", "s1"), (10, "x" * 3000 + " é ü " + "y" * 20, "s0"),
       (11, "\n".join(f"Line{k} goes{k} on and{k} ends." for k in range(3000)), "s1"), (12, "Menu | Home | About | Login\nA clean line follows here with words.", "s0")]


@pytest.fixture(scope="module")
def odd(spark):
    return land(spark.createDataFrame([(i, t, "en", s, len(t or ""), *"abcdefg") for i, t, s in ODD], SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return land(spark.createDataFrame([], SCHEMA), "none")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_quality_held_out_and_odd_rows(spark, odd, none):
    sf = SF_SMALL.replace("0.001", "0.01")
    out = queries.op1_attention_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out) and len(out) > 50
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(d, spark.read.parquet(f"{sf}/labels.parquet"))
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    blank = quality.train(d, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}


def test_quality_learns_one_row_of_an_id(spark, docs):
    labels = land(docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).limit(60), "some-labels")
    hot = docs.join(labels, "doc_id", "left_semi").limit(2).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("i")
    one, many = (quality.train(land(d, "hot"), labels) for d in (docs, docs.unionByName(hot)))
    assert np.array_equal(one.lexicon, many.lexicon) and np.allclose(one.mean, many.mean) and np.allclose(one.scale, many.scale)


def test_quality_scores_by_brute_force(spark, docs, odd):
    """Whole path of a score, from the text to the probability, against plain loops."""
    sf = SF_SMALL.replace("0.001", "0.01")
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))

    def hash_of(word):
        data = np.frombuffer(word, np.uint8)
        return int(quality._bucket(words.hash_spans(data, np.array([0]), np.array([len(data)])))[0])

    long = [(1, " ".join(f"Word{k % 977}, a b! é{k}" for k in range(1500))), (2, "W" * 300 + " tail " * 70)]
    for table in (docs.select("doc_id", "text").filter("doc_id < 60"), odd.select("doc_id", "text"), spark.createDataFrame(long, "doc_id long, text string")):
        got = quality.score(table.select("doc_id", "text"), model, carry=("text",)).collect()
        assert got
        for r in got:
            p, n, top = brute.quality(r.text, model, hash_of)
            assert r.n_passages == n and np.allclose((r.score, r.top_attention), (p, top), atol=1e-9)


def test_quality_bounds_its_passages(spark, monkeypatch):
    """Long texts in the sample do not make what the network learns from larger than its bound."""
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, size, y: seen.append(size) or fit(x, size, y, epochs=1))
    rows = [(k, "word " * (64 * 30 if k % 3 else 64 * 500)) for k in range(90)]
    table = land(spark.createDataFrame(rows, "doc_id long, text string"), "long-texts")
    labels = spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id long, quality int")
    model = quality.train(table, labels, passages=600)
    assert seen[0].sum() <= 600 and seen[0].sum() > 500 and set(seen[0]) == {30}
    assert quality.score(table, model).count() == 90
    quality.train(table, labels)
    assert set(seen[1]) == {30, 500}


def test_quality_gradients():
    rng = np.random.default_rng(0)
    size = np.array([1, 4, 2])
    begin, x, y = np.array([0, 1, 5]), rng.normal(size=(7, 18)), np.array([1.0, 0.0, 1.0])
    w = quality.fit(x, size, y, epochs=1)
    loss = lambda w: -np.mean([np.log(p if t else 1 - p) for p, t in zip(quality._forward(x, begin, size, w)[0], y)])
    grad = quality._gradients(x, y, begin, size, w, 0.0)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        up, down = ({**w, k: w[k] + s * 1e-6 * (np.indices(w[k].shape).sum(axis=0) == 0)} for s in (1, -1))
        assert abs((loss(up) - loss(down)) / 2e-6 - grad[k][at]) < 1e-6


def test_language_model_brute(spark, docs, odd, none):
    rows = pairs(docs)
    train = [t for i, t in rows if brute.crc(i) % 10]
    got = {r.doc_id: r for r in queries.op2_kneser_ney_lm(spark, SF_SMALL).collect()}
    for (i, _), want in zip(rows, brute.kneser_ney(train, [t for _, t in rows]), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.held_out == (brute.crc(i) % 10 == 0)
        assert abs(r.base_score - want[3]) < 1e-6 and abs(r.score - want[4]) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    model = lm.train(odd)
    texts = [t for _, t in pairs(odd)]
    want = sorted(x[3:] for x in brute.kneser_ney(texts, texts))
    assert np.allclose(sorted((r.base_score, r.score) for r in lm.score(odd, model).collect()), want)
    empty = lm.train(none)
    assert lm.score(none, model).count() == 0 and {r.n_known for r in lm.score(odd, empty).collect()} == {0}


def check_packing(rows, texts):
    """Pieces hold every id of every document once; padding is what little the contract leaves."""
    tokenizer = packing.load_tokenizer(queries.tokenizer_path())
    want = sorted((i is None, i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID])) for i, t in texts)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    for i, pieces in by.items():
        docs = [np.array(w[2], "<u4") for w in want if w[1] == i]
        for r in pieces:
            assert any(len(d) == r.doc_tokens and d[r.start:r.start + r.length].tobytes() == r.ids for d in docs)
        assert sum(r.length for r in pieces) == sum(len(d) for d in docs)
        if len(docs) == 1:
            assert [r.start for r in sorted(pieces, key=lambda r: r.start)] == list(np.cumsum([0] + [r.length for r in sorted(pieces, key=lambda r: r.start)])[:-1])
    assert len(by) == len({w[1] for w in want})
    pad = 0
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= packing.WINDOW
        pad += packing.WINDOW - at if at & (at - 1) else 0
    assert pad == 0


def test_packing_round_trip(spark, docs, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 60_000)
    monkeypatch.setattr(packing, "RANGE_BYTES", 100_000)
    path = queries.tokenizer_path()
    check_packing(packing.pack(docs, path).collect(), pairs(docs))
    check_packing(packing.pack(odd, path).collect(), pairs(odd))
    assert packing.pack(none, path).count() == 0


def test_packing_searches_the_whole_corpus(spark, docs, monkeypatch):
    """Small blocks of the index, neighbours in any of them: the same as brute force over all documents."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    path = queries.tokenizer_path()
    rows = packing.tokenised(docs, path)
    corpus = packing.Corpus(rows, path)
    assert len(corpus.blocks) > 3
    unzip, ends = packing.zstandard.ZstdDecompressor(), packing.word_ends(path)
    by_row = {r.row_no: packing._terms(packing._ids(r.ids, unzip), ends).tolist() for r in rows.collect()}
    terms = [by_row[r] for r in corpus.row.tolist()]
    df, tf = defaultdict(int), [defaultdict(int) for _ in terms]
    for i, words in enumerate(terms):
        for w in words:
            df[w] += not tf[i][w]
            tf[i][w] += 1
    mean = sum(map(len, terms)) / len(terms)
    weight = [{w: float(packing.bm25(df[w], c, len(t), len(terms), mean)) for w, c in x.items()} for x, t in zip(tf, terms)]
    free = np.arange(len(terms)) % 5 > 0
    seeds = np.arange(3, len(terms), max(1, len(terms) // 20))
    got = defaultdict(dict)
    for s, d, x in zip(*corpus.neighbours(seeds, free, 10)):
        got[s][d] = x
    far = 0
    for s in seeds:
        want = {d: sum(weight[d].get(w, 0) for w in tf[s] if df[w] > 1) for d in range(len(terms)) if free[d] and d != s}
        top = sorted(want.values(), reverse=True)[:10]
        assert np.allclose(sorted(got[s].values(), reverse=True), [x for x in top if x > 0], rtol=1e-4)
        assert all(abs(want[d] - x) <= 1e-4 * x for d, x in got[s].items())
        far += sum(np.searchsorted(corpus.base, d, side="right") != np.searchsorted(corpus.base, s, side="right") for d in got[s])
    assert far


def test_packing_index_follows_the_free_documents(spark, docs, monkeypatch):
    """The blocks are written anew as documents are used up, fewer and with the same neighbours."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    path = queries.tokenizer_path()
    corpus = packing.Corpus(packing.tokenised(docs, path), path)
    n, blocks = len(corpus.size), len(corpus.blocks)
    free = np.arange(n) % 5 == 0
    seeds = np.flatnonzero(free)[::max(1, n // 100)]
    found = lambda: [x.tolist() for x in corpus.neighbours(seeds, free, 10)]
    held = lambda: sum(np.load(f"{corpus.folder}/{b}-doc.npy").size for b in corpus.blocks)
    want, before = found(), held()
    corpus.forget(free)
    assert corpus.no.tolist() == np.flatnonzero(free).tolist() and len(corpus.blocks) < blocks and held() < before / 2
    got = found()
    assert got[:2] == want[:2] and np.allclose(got[2], want[2], rtol=1e-5) and want[0]
    asked, real = [], packing.Corpus.neighbours
    monkeypatch.setattr(packing.Corpus, "neighbours", lambda self, s, free, k: asked.append((len(self.no), int(free.sum()))) or real(self, s, free, k))
    packing.pack_corpus(corpus_of_all := packing.Corpus(packing.tokenised(docs, path), path))
    assert len(asked) > 2 and all(0.8 * held <= left for held, left in asked) and len(corpus_of_all.no) < n


def test_packing_keeps_the_best_of_each_seed():
    rng = np.random.default_rng(5)
    scores = (rng.random((4, 900)) * 7).astype(np.float32) * (rng.random((4, 900)) > 0.2)
    scores[3, 5:] = 0
    best = packing.Best(4, 30)
    for c in range(0, 900, 100):
        i, j = np.nonzero(scores[:, c:c + 100] > best.least[:, None])
        best.add(i, j + c, scores[i, j + c])
    seed, doc, score = best.get()
    for s in range(4):
        want = np.argsort(-scores[s], kind="stable")[:min(30, int((scores[s] > 0).sum()))]
        assert doc[seed == s].tolist() == want.tolist() and score[seed == s].tolist() == scores[s, want].tolist()


def test_packing_follows_bm25():
    a, b = np.arange(50, dtype=np.uint64), np.arange(100, 150, dtype=np.uint64)
    index = packing.Index([a, b, a[:30], b[:30], a[:10]])
    assert list(index.neighbours(0)[:3]) == [0, 2, 4] or list(index.neighbours(0)[:2]) == [2, 0]
    assert set(index.neighbours(1)) == {1, 3}
    pieces = packing.pack_shard(np.array([50, 50, 30, 30, 10]), index, window=80)
    assert [p[0] for p in pieces[:2]] == [0, 2] and {p[0] for p in pieces if p[3] == 1} >= {1, 3}


def test_packing_queries_with_all_words():
    strong, weak = np.arange(40, dtype=np.uint64), np.arange(100, 140, dtype=np.uint64)
    index = packing.Index([np.concatenate([strong, weak]), strong, weak, *[weak[:20]] * 5])
    assert set(index.neighbours(0)) == set(range(8))
    got = packing.Index([np.arange(80, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.arange(30, 80, dtype=np.uint64)])
    assert set(got.neighbours(0)) == {0, 1, 2} and len(got.query) == 80 + 50 + 50


@pytest.mark.parametrize("limit", [2000, 40_000, 1 << 30])
def test_sharding_brute(spark, odd, none, docs, limit):
    for table in (docs, odd):
        got = sharding.assign_shards(table, limit_bytes=limit).collect()
        assert len(got) == table.count()
        total, count = defaultdict(int), defaultdict(int)
        for r in got:
            assert len(r.shard_bits) == r.depth
            total[r.shard_bits, r.page] += r.n_bytes
            count[r.shard_bits, r.page] += 1
        assert all(t <= limit or count[k] == 1 for k, t in total.items())
        shards = {r.shard_bits for r in got}
        for s in shards:  # prefix-free, and no split without need
            assert not any(s[:k] in shards for k in range(len(s)))
            if s:
                assert sum(t for (b, _), t in total.items() if b.startswith(s[:-1])) > limit
    assert sharding.assign_shards(none, limit_bytes=limit).count() == 0


def test_sharding_splits_equal_keys(spark):
    rows = land(spark.createDataFrame([(7, "t" * 100)] * 50 + [(7, "u" * 30)] * 9, "doc_id long, text string").repartition(4), "equal")
    pages = defaultdict(int)
    for r in sharding.assign_shards(rows, limit_bytes=1000).collect():
        pages[r.page] += r.n_bytes
    assert sum(pages.values()) == 5270 and max(pages.values()) <= 1000 and len(pages) == 6


def test_written_shards_follow_the_plan(spark, tmp_path):
    rows = [(7, "t" * 100)] * 50 + [(7, "u" * 30)] * 9 + [(None, "n" * 90)] * 30 + [(i, "v" * 50) for i in range(100, 140)] + [(8, None)]
    table = land(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "equal")
    plan = sharding.write_shards(table, f"{tmp_path}/shards", limit_bytes=1000).collect()
    want, got = defaultdict(list), defaultdict(list)
    for r in plan:
        want[f"b{r.shard_bits}-{r.page}"].append((r.doc_id is None, r.doc_id or 0, r.n_bytes))
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    for r in back:
        got[r._shard].append((r.doc_id is None, r.doc_id or 0, len(r.text or "")))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert max(sum(n for *_, n in v) for v in got.values()) <= 1000
    assert sorted((r.doc_id or -1, r.text or "") for r in back) == sorted((i or -1, x or "") for i, x in rows)


def test_substring_brute(spark, docs, odd, none, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 100_000)
    got = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s"), "kept_text").collect()
    want = brute.repeats(pairs(docs))
    assert {r.doc_id: (r.n_words, r.n_removed, r.s, r.kept_text) for r in got} == want
    assert sum(w[1] for w in want.values()) > 500
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(odd).collect())
    by = {(d, n): r for _, d, n, r in got}
    assert by[6, 62] == 0 and by[7, 62] == 60 and by[8, 60] == 0 and by[0, 121] == 0
    assert [g[2:] for g in got if g[0]] == [(0, 0), (60, 60)]  # null ids rank last
    assert substring.remove_repeats(none).count() == 0


def test_substring_survives_hash_collisions(spark, docs, monkeypatch):
    rows = [(i, t) for i, t in pairs(docs)][:25]
    few = land(spark.createDataFrame(rows, "doc_id long, text string"), "few").toArrow()
    table = few.append_column("row_no", [list(range(len(rows)))]).append_column("block", [[0] * len(rows)])
    monkeypatch.setattr(substring, "run_hashes", lambda h, start, length: (h[start] & np.uint64(7)))
    sent = substring._cutter(1)(table.append_column("row", [[{"none": None}] * len(rows)]))
    answers = substring._counter()(sent)
    out = substring._dropper(1)(table.append_column("row", [[{"none": None}] * len(rows)]), answers)
    want = brute.repeats(rows)
    assert {i: n for i, n in zip(out["doc_id"].to_pylist(), out["n_removed"].to_pylist())} == {i: w[1] for i, w in want.items()}


def test_rules_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in rules.clean_lines(odd).collect()}
    assert rules.clean_lines(odd).count() == len(ODD) and rules.clean_lines(none).count() == 0
    assert all(got[i].n_words == 0 and got[i].base_failed and not got[i].kept for i in (1, 2, 3))
    assert got[0].base_failed and got[0].n_repeat_words == 120  # all but the last word
    assert got[11].kept and got[11].n_dup_lines == 0 and got[12].clean_text == "A clean line follows here with words."


def test_chat_round_trip_and_states(spark):
    said = ["\\### Assistant: </turn> ok", "<turn user>\nhi</turn>\n", "\\l\\b\\g", None, ""]
    rows = [(1, k, r, said[k % 5]) for k, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(2, 0, "assistant", "no"), (2, 1, "user>", "x"), (None, 0, None, "y"), (3, None, "user", "a"), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (4, 0, "user", "q")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(r, t or "") for _, _, r, t in rows[:5]]
    assert got[1].valid and got[1].loss == said[2] and "".join(s.text for s in got[1].segments) == got[1].formatted
    assert not got[2].valid and got[2].bad_turn == 0 and [t.role for t in got[2].back] == ["assistant", "user>"]
    assert got[3].n_turns == 3 and got[3].bad_turn == 2 and got[3].loss == "bb" and not got[4].valid and got[4].bad_turn is None
    assert got[None].back[0].text == "y" and chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(close="END\n")


def test_embeddings_brute(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "TILE", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    vecs = [[float(x) for x in base[k % 12] + rng.normal(scale=0.08, size=6)] for k in range(150)] + [[1.0] * 6] * 5
    rows = [(k, v, k % 3) for k, v in enumerate(vecs)]
    odd = [(200, None, 0), (201, [], 0), (202, [0.0] * 6, 0), (203, [1.0, None, 1.0], 0), (204, [float("nan")] * 6, 1), (205, [float("inf")] * 6, 1),
           (206, [1.0] * 6, None), (None, [1.0] * 6, 0), (207, [1.0, 1.0], 0), (208, [1e200] * 2, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, cid string")
    got = {r.vec_id: r for r in embdedup.near_duplicates(df).collect()}
    x = np.array(vecs)
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    links = [(a, b) for a, _, p in rows for b, _, q in rows if a < b and p == q and cos[a, b] >= 0.98]
    comp = brute.components(range(len(rows)), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert len(links) > 50
    for k in range(len(rows)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n[k], comp[k], comp[k] == k), k
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(200, 207)) and got[None].component_id is None
    assert got[207].n_links == 1 and got[208].component_id == 207
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_simhash_brute(spark, docs, odd, none):
    fp, comp = brute.simhash(pairs(docs))
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert {i: (f"{fp[i]:016x}", comp[i]) for i in fp} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD) and all(int(r.fingerprint, 16) in {brute.fingerprint(t) for i, t, _ in ODD if i == r.doc_id} for r in rows)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.first_of_groups(odd).columns == odd.columns
    assert sorted(r.doc_id for r in simhash.first_of_groups(odd).filter("doc_id in (1, 2, 3, 9)").collect()) == [1, 9]


def test_golay_keys_find_all_within_three_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-2**63, 2**63, 40, dtype=np.int64)
    near = [int(b) for b in base]
    for b in base:
        flips = rng.choice(64, 3, replace=False)
        near.append(int(np.uint64(b.view(np.uint64)) ^ np.uint64(sum(1 << int(f) for f in flips)).astype(np.uint64)))
    fps = np.array([n & (2**64 - 1) for n in near], np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    got = {(r.a, r.b) for r in simhash.near_links(df).collect()}
    want = {(min(a, b), max(a, b)) for n, a in enumerate(fps) for b in fps[n + 1:] if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) >= 40


def test_mixing_targets(spark, docs, odd, none):
    for table in (docs, odd):
        got = mixing.mix_plan(table).collect()
        assert len(got) == table.count() and all(0 <= r.taken <= 2 * r.size for r in got)
        by = defaultdict(int)
        source = defaultdict(set)
        for r in got:
            by[r.source_size, r.target] += r.taken
        total = sum(r.size for r in got)
        assert all(abs(t - k[1] * max(1, round(t / max(k[1], 1)))) <= 20 or k[1] == 0 for k, t in by.items()) and source is not None
        assert abs(sum(by.values()) - 1.5 * total) < 30
        assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    assert mixing.mix_plan(none).count() == 0
    out = mixing.curriculum(odd)
    assert out.columns == odd.columns
    assert sum(len(brute.words(t)) for _, t in pairs(out)) == sum(r.taken for r in mixing.mix_plan(odd).collect())
    assert mixing.curriculum(odd).collect() == out.collect()


def test_pipeline_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = land(stages["quality_classifier"](spark, docs, SF_SMALL), "p1")
    assert kept.columns == docs.columns and set(pairs(kept)) <= set(pairs(docs))
    one = land(stages["simhash_dedup"](spark, kept, SF_SMALL), "p2")
    _, comp = brute.simhash(pairs(kept))
    assert sorted(pairs(one)) == sorted((i, t) for i, t in pairs(kept) if comp[i] == i)
    cut = land(stages["substring_dedup"](spark, one, SF_SMALL), "p3")
    want = brute.repeats(pairs(one))
    assert cut.columns == docs.columns and dict(pairs(cut)) == {i: want[i][3] if want[i][1] else t for i, t in pairs(one)}
    mixed = land(stages["curriculum_mix"](spark, cut, SF_SMALL), "p4")
    plan = {r.doc_id: r for r in mixing.mix_plan(cut).collect()}
    n = defaultdict(int)
    for i, t in pairs(mixed):
        n[i] += len(brute.words(t))
    assert mixed.columns == docs.columns and n == {i: r.taken for i, r in plan.items() if r.taken}
    packed = stages["bm25_packing"](spark, mixed, SF_SMALL).collect()
    check_packing(packed, pairs(mixed))


def test_pipeline_on_odd_rows(spark, odd, none):
    tables, table = [odd], odd
    for name, stage in corpus_pipeline.STAGES:
        table = land(stage(spark, table, SF_SMALL), f"odd-{name}")
        assert name == "bm25_packing" or table.columns == odd.columns
        tables.append(table)
    whole = lambda df: Counter(tuple(r) for r in df.collect())
    rows, kept, one, cut, mixed, packed = tables
    assert whole(kept) <= whole(rows) and whole(one) <= whole(kept)
    ids = [r.doc_id for r in one.collect()]
    assert len(ids) == len(set(ids)) and sum(not (t or "").strip(" \t\n\x0b") for _, t in pairs(one)) <= 1
    assert Counter(r.doc_id for r in cut.collect()) == Counter(ids)
    assert {i for i, _ in pairs(mixed)} <= set(ids) and all(brute.words(t) for _, t in pairs(mixed))
    check_packing(packed.collect(), pairs(mixed))
    table = none
    for name, stage in corpus_pipeline.STAGES:
        table = land(stage(spark, table, SF_SMALL), f"none-{name}")
        assert table.count() == 0


def test_pipeline_stage_called_again_keeps_unread_results(spark, odd):
    """Two callers of one stage: the first reads its result after the second has called."""
    for name, stage in corpus_pipeline.STAGES:
        if name in ("simhash_dedup", "bm25_packing"):
            first, second = stage(spark, odd, SF_SMALL), stage(spark, odd, SF_SMALL)
            assert first.count() == second.count() > 0


def test_words_tokenised_together_or_alone():
    words = ["plain", "end.", "Émile,", "it's", "a", "...", "x!!", "don't.", "naïve", "3.14", "<|endoftext|>", "ＡＢ", "é", "ß", "µ", "a.b", "ª", "word|", "ﬁ", "q" * 400]
    words = words * 60
    path = queries.tokenizer_path()
    ids, size = packing.encode_words(words, path)
    want = [x.ids for x in packing.load_tokenizer(path).encode_batch(words, add_special_tokens=False)]
    assert [list(x) for x in np.split(ids, np.cumsum(size)[:-1])] == want


def test_line_rules_on_single_lines(spark):
    lines = {"Home: Products; Support; Contact us": True, "Buy now! Best price on": True, "(c) 2020 Example. All rights reserved. Privacy Terms": True,
             "She baked a cookie for the judge and it was good.": False, "The javascript engine compiles each function once.": False,
             "Please enable JavaScript in your browser to go on.": True, "Subscribe to our newsletter!": True, "Lorem ipsum dolor sit amet.": True,
             "» » » Read more » » »": True, "- - - - - - - - - - - - - - - - - - - - - - - About us - - -.": True, "He said so.": False, "It ends here (so it does)": False}
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.text: r.fails for r in rows.select("text", rules.line_fails(F.col("text"), F.lit(True)).alias("fails")).collect()}
    assert got == lines
    lost = rules.clean_lines(rows).select("doc_id", "n_lost", "n_words").collect()
    assert all((r.n_lost == r.n_words) == fails for r, fails in zip(sorted(lost, key=lambda r: r.doc_id), lines.values(), strict=True))
